"""Operators on points: arithmetic, transforms, filters, statistics, set operations.

All are column expressions, grouped aggregates and joins on the survey's key; a survey's rows are never
brought to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.model import step

from .statistics import Quantile, group_stats, with_aggregates

KEY = ["survey_id"]


def median(col: str | Column) -> Column:
    return F.percentile(col, F.lit(0.5))


# arithmetic ---------------------------------------------------------------


@step("add_to_points", "points")
def add(df: DataFrame, value: float, col: str = "value") -> DataFrame:
    return df.withColumn(col, F.col(col) + F.lit(float(value)))


@step("subtract_from_points", "points")
def subtract(df: DataFrame, value: float, col: str = "value") -> DataFrame:
    return df.withColumn(col, F.col(col) - F.lit(float(value)))


@step("multiply_points_by", "points")
def multiply(df: DataFrame, value: float, col: str = "value") -> DataFrame:
    return df.withColumn(col, F.col(col) * F.lit(float(value)))


@step("divide_points_by", "points")
def divide(df: DataFrame, value: float, col: str = "value") -> DataFrame:
    """By zero gives NULL, as there are no infinities in a survey."""
    return df.withColumn(col, F.try_divide(F.col(col), F.lit(float(value))))


for _n, _f in (("add_to_grid", add), ("subtract_from_grid", subtract), ("multiply_grid_by", multiply), ("divide_grid_by", divide)):
    step(_n, "grid")(lambda df, value, _f=_f: _f(df, value, "z"))


@step("set_points_mean", "points")
def set_mean(df: DataFrame, value: float, col: str = "value", by: list[str] | None = None, method: str = "additive") -> DataFrame:
    return _set_level(df, value, col, by or KEY, F.avg(col), method)


@step("set_points_median", "points")
def set_median(df: DataFrame, value: float, col: str = "value", by: list[str] | None = None, method: str = "additive") -> DataFrame:
    return _set_level(df, value, col, by or KEY, Quantile(col, 0.5), method)


def _set_level(df: DataFrame, target: float, col: str, by: list[str], stat: Column | Quantile, method: str) -> DataFrame:
    if method not in ("additive", "multiplicative"):
        raise ValueError(f"method must be additive or multiplicative, not {method!r}")
    out = with_aggregates(df, by, __s=stat)
    new = F.col(col) + (F.lit(float(target)) - F.col("__s")) if method == "additive" else F.try_divide(F.col(col) * F.lit(float(target)), F.col("__s"))
    return out.withColumn(col, new).drop("__s")


step("set_grid_mean", "grid")(lambda df, value, method="additive": set_mean(df, value, "z", KEY, method))
step("set_grid_median", "grid")(lambda df, value, method="additive": set_median(df, value, "z", KEY, method))
step("set_profile_mean", "grid")(lambda df, value, method="additive": set_mean(df, value, "z", ["survey_id", "ix"], method))
step("set_profile_median", "grid")(lambda df, value, method="additive": set_median(df, value, "z", ["survey_id", "ix"], method))


@step("log_transform_points", "points")
def log_transform(df: DataFrame, factor: float = 5.0, col: str = "value") -> DataFrame:
    """Sign-keeping natural logarithm: sign(v) ln(1 + factor |v|)."""
    return df.withColumn(col, F.signum(col) * F.log1p(F.abs(col) * F.lit(float(factor))))


step("log_transform_grid", "grid")(lambda df, factor=5.0: log_transform(df, factor, "z"))


def piecewise_log10(df: DataFrame, factor: float = 5.0, col: str = "value") -> DataFrame:
    """Base-10 variant: 0 within 1/factor of zero, else sign(v) log10(factor |v|)."""
    m = F.abs(F.col(col)) * F.lit(float(factor))
    return df.withColumn(col, F.when(m > 1, F.signum(col) * F.log10(m)).when(F.col(col).isNotNull(), F.lit(0.0)))


def to_levels(df: DataFrame, levels: int = 256, col: str = "z", by: list[str] | None = None) -> DataFrame:
    """Integer levels 0..levels-1, halves to even; a flat survey is level 0. The column ``level`` is added."""
    out = with_aggregates(df, by or KEY, __lo=F.min(col), __hi=F.max(col))
    size = (F.col("__hi") - F.col("__lo")) / F.lit(levels)
    lev = F.coalesce(F.rint(F.try_divide(F.col(col) - F.col("__lo"), size)), F.when(F.col(col).isNotNull(), F.lit(0.0)))
    return out.withColumn("level", F.greatest(F.least(lev, F.lit(levels - 1.0)), F.lit(0.0)).cast("int")).drop("__lo", "__hi")


def from_levels(df: DataFrame, low: float, high: float, levels: int = 256) -> DataFrame:
    return df.withColumn("z", F.lit(float(low)) + F.col("level") * F.lit((high - low) / levels))


# geometry -----------------------------------------------------------------


@step("rotate_points", "points")
def rotate(df: DataFrame, angle: float, center: tuple[float, float] = (0.0, 0.0), clockwise: bool = False) -> DataFrame:
    """About center by angle in degrees."""
    t = F.radians(F.lit(float(-angle if clockwise else angle)))
    dx, dy = F.col("x") - F.lit(float(center[0])), F.col("y") - F.lit(float(center[1]))
    return df.withColumns({"x": F.lit(float(center[0])) + dx * F.cos(t) - dy * F.sin(t), "y": F.lit(float(center[1])) + dx * F.sin(t) + dy * F.cos(t)})


def rotate_about(df: DataFrame, angle: float, where: str = "centroid", clockwise: bool = True) -> DataFrame:
    """About each survey's centroid or a corner of its box: BL, BR, TL, TR."""
    stats = {"centroid": (F.avg("x"), F.avg("y")), "BL": (F.min("x"), F.min("y")), "BR": (F.max("x"), F.min("y")), "TL": (F.min("x"), F.max("y")), "TR": (F.max("x"), F.max("y"))}
    cx, cy = stats[where]
    out = with_aggregates(df, KEY, __cx=cx, __cy=cy)
    t = F.radians(F.lit(float(-angle if clockwise else angle)))
    dx, dy = F.col("x") - F.col("__cx"), F.col("y") - F.col("__cy")
    return out.withColumns({"x": F.col("__cx") + dx * F.cos(t) - dy * F.sin(t), "y": F.col("__cy") + dx * F.sin(t) + dy * F.cos(t)}).drop("__cx", "__cy")


@step("translate_points", "points")
def translate(df: DataFrame, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    return df.withColumns({"x": F.col("x") + F.lit(float(dx)), "y": F.col("y") + F.lit(float(dy))})


# filters ------------------------------------------------------------------


@step("crop_points", "points")
def crop(df: DataFrame, xmin: float | None = None, xmax: float | None = None, ymin: float | None = None, ymax: float | None = None) -> DataFrame:
    """Inclusive bounds; those that are None are open. The filter reaches the scan."""
    for c, lo, hi in (("x", xmin, xmax), ("y", ymin, ymax)):
        if lo is not None:
            df = df.where(F.col(c) >= F.lit(float(lo)))
        if hi is not None:
            df = df.where(F.col(c) <= F.lit(float(hi)))
    return df


@step("get_track", "points")
def get_track(df: DataFrame, tracks: int | list[int]) -> DataFrame:
    return df.where(F.col("track").isin(tracks if isinstance(tracks, list) else [tracks]))


@step("threshold_points", "points")
def threshold(df: DataFrame, vmin: float | None = None, vmax: float | None = None, fill: str | float = "clip", col: str = "value", by: list[str] | None = None) -> DataFrame:
    """Replace what is outside [vmin, vmax] by the bound, the inliers' mean or median, NULL ('null'), or a number.

    The inliers' statistics are taken before anything is changed.
    """
    v = F.col(col)
    low = v < F.lit(float(vmin)) if vmin is not None else F.lit(False)
    high = v > F.lit(float(vmax)) if vmax is not None else F.lit(False)
    if fill == "clip":
        return df.withColumn(col, F.when(low, F.lit(None if vmin is None else float(vmin))).when(high, F.lit(None if vmax is None else float(vmax))).otherwise(v))
    if fill == "null":
        return df.withColumn(col, F.when(low | high, F.lit(None)).otherwise(v))
    if fill in ("mean", "median"):
        inlier = F.when(~(low | high), v)
        out = with_aggregates(df, by or KEY, __s=F.avg(inlier) if fill == "mean" else Quantile(inlier, 0.5))
        return out.withColumn(col, F.when(low | high, F.col("__s")).otherwise(v)).drop("__s")
    return df.withColumn(col, F.when(low | high, F.lit(float(fill))).otherwise(v))


step("threshold_grid", "grid")(lambda df, vmin=None, vmax=None, fill="clip": threshold(df, vmin, vmax, fill, "z"))
step("threshold_profiles", "grid")(lambda df, vmin=None, vmax=None, fill="median": threshold(df, vmin, vmax, fill, "z", ["survey_id", "ix"]))


def threshold_stats(df: DataFrame, vmin: float | None = None, vmax: float | None = None, col: str = "value", by: list[str] | None = None) -> DataFrame:
    """(survey_id, modified, percent); NULL cells count in the total."""
    v = F.col(col)
    out = F.coalesce((v < F.lit(vmin)) if vmin is not None else F.lit(False), F.lit(False)) | F.coalesce((v > F.lit(vmax)) if vmax is not None else F.lit(False), F.lit(False))
    n = F.count_if(out)
    return df.groupBy(*(by or KEY)).agg(n.alias("modified"), (F.lit(100.0) * n / F.count("*")).alias("percent"))


def blank_rows(df: DataFrame, cols: list[str], first: int, last: int) -> DataFrame:
    """NULL in cols for first <= pid <= last."""
    return df.withColumns({c: F.when(F.col("pid").between(first, last), F.lit(None)).otherwise(F.col(c)) for c in cols})


def distinct_first(df: DataFrame, cols: list[str]) -> DataFrame:
    """Of rows equal in cols the first by pid."""
    w = Window.partitionBy(*cols).orderBy("pid")
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


# statistics ---------------------------------------------------------------


def stats(df: DataFrame, col: str = "value", by: list[str] | None = None) -> DataFrame:
    """Minimum, maximum, mean and population standard deviation."""
    return df.groupBy(*(by or KEY)).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("stdev"))


def spread(df: DataFrame, col: str = "value", by: list[str] | None = None, vmin: float | None = None, vmax: float | None = None) -> DataFrame:
    """Mean, deviation, quartiles and their distance, of values within the bounds."""
    for lo, op in ((vmin, ">="), (vmax, "<=")):
        if lo is not None:
            df = df.where(f"`{col}` {op} {float(lo)!r}")
    got = group_stats(df, by or KEY, mean=F.avg(col), stdev=F.stddev_pop(col), median=Quantile(col, 0.5), q1=Quantile(col, 0.25), q3=Quantile(col, 0.75))
    return got.withColumn("iqr", F.col("q3") - F.col("q1"))


def mid_interval(df: DataFrame, percent: float, col: str = "value", by: list[str] | None = None) -> DataFrame:
    """Bounds of the central ``percent`` of the values."""
    lo = (100 - percent) / 200
    return group_stats(df, by or KEY, low=Quantile(col, lo), high=Quantile(col, 1 - lo))


def median_step(df: DataFrame, axis: str = "x", digits: int = 6, by: list[str] | None = None) -> DataFrame:
    """Median gap between sorted distinct coordinates, halves to even; 0 below two coordinates.

    The window sees a survey's distinct coordinates only, not its rows.
    """
    by = by or KEY
    w = Window.partitionBy(*by).orderBy(axis)
    pts = df.where(F.col(axis).isNotNull()).select(*by, axis).distinct()
    gaps = pts.withColumn("gap", F.col(axis) - F.lag(axis).over(w))
    return group_stats(gaps, by, step=Quantile("gap", 0.5)).withColumn("step", F.coalesce(F.bround("step", digits), F.lit(0.0)))


def centroid(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or KEY)).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def bounding_box(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Corners in the order BL, BR, TL, TR."""
    by = by or KEY
    got = df.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    corner = lambda i, x, y: F.struct(F.lit(i).alias("corner"), F.col(x).alias("x"), F.col(y).alias("y"))
    return got.select(*by, F.inline(F.array(corner(0, "x0", "y0"), corner(1, "x1", "y0"), corner(2, "x0", "y1"), corner(3, "x1", "y1"))))


def histogram(df: DataFrame, bins: int = 50, col: str = "value", low: float | None = None, high: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts of equally wide bins, the last one closed; empty bins are left out."""
    by = by or KEY
    v = F.col(col)
    df = df.where(v.isNotNull())
    if low is None or high is None:
        df = with_aggregates(df, by, __lo=F.min(col), __hi=F.max(col))
    lo = F.lit(float(low)) if low is not None else F.col("__lo")
    hi = F.lit(float(high)) if high is not None else F.col("__hi")
    df = df.where((v >= lo) & (v <= hi))
    k = F.least(F.floor((v - lo) * F.lit(bins) / F.when(hi > lo, hi - lo).otherwise(1.0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, k.alias("bin")).agg(F.count("*").alias("n"))


def extremes(df: DataFrame, n: int, col: str = "value") -> DataFrame:
    """The n smallest and n largest values with their pids (a top-k report)."""
    low = df.where(F.col(col).isNotNull()).orderBy(F.asc(col), "pid").limit(n).select(F.lit("min").alias("kind"), "pid", F.col(col).alias("value"))
    high = df.where(F.col(col).isNotNull()).orderBy(F.desc(col), "pid").limit(n).select(F.lit("max").alias("kind"), "pid", F.col(col).alias("value"))
    return low.unionAll(high)


def gaussian_fit(df: DataFrame, bins: int = 50, col: str = "value", by: list[str] | None = None) -> DataFrame:
    """Normal curve through the histogram, by moments: amplitude, centre, deviation."""
    by = by or KEY
    got = df.groupBy(*by).agg(F.avg(col).alias("x0"), F.stddev_pop(col).alias("sigma"), F.count(col).alias("n"), ((F.max(col) - F.min(col)) / bins).alias("width"))
    return got.select(*by, (F.col("n") * F.col("width") / (F.col("sigma") * F.sqrt(F.lit(2 * 3.141592653589793)))).alias("a"), "x0", "sigma")


# set operations and compatibility -----------------------------------------


def fuse(*frames: DataFrame) -> DataFrame:
    """UNION ALL of at least two frames with the same columns."""
    if len(frames) < 2:
        raise ValueError("at least two frames are needed")
    if any(set(f.columns) != set(frames[0].columns) for f in frames):
        raise ValueError("the frames' columns differ")
    return reduce(DataFrame.unionByName, frames)


def identical(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: whether all rows agree in cols (NULL equals NULL)."""
    return df.agg((F.countDistinct(F.to_json(F.struct(*cols))) <= 1).alias("identical"))


def with_profiles(df: DataFrame, axis: str | None = None) -> DataFrame:
    """Number runs of constant coordinate as profiles, from 0 per survey, in order of pid."""
    if axis is None:
        got = df.agg(F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny")).first()
        axis = "x" if got["nx"] <= got["ny"] else "y"
    w = Window.partitionBy("survey_id").orderBy("pid")
    change = F.coalesce((~F.col(axis).eqNullSafe(F.lag(axis).over(w))).cast("int"), F.lit(0))
    first = F.lag("pid").over(w).isNull()
    return df.withColumn("__c", F.when(first, 0).otherwise(change)).withColumn("profile", F.sum("__c").over(w).cast("int")).drop("__c")
