"""Operators along tracks: ordered windows keyed by survey and track, levelling, trends."""

from __future__ import annotations

from math import fsum, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.model import step

from .points import KEY
from .statistics import Quantile, few, group_stats, local, matched, settled, with_aggregates

TRACK = ["survey_id", "track"]


def _along(by: list[str], order: str = "pid"):
    return Window.partitionBy(*by).orderBy(order)


@step("distance_along_track", "points")
def distance_along_track(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ``distance``: summed lengths of the legs so far, 0 at a track's first point."""
    w = _along(by or TRACK)
    leg = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    return df.withColumn("__leg", F.coalesce(leg, F.lit(0.0))).withColumn("distance", F.sum("__leg").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__leg")


def _array_median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(a)
    return F.when(n > 0, (F.element_at(s, (F.floor((n + 1) / 2)).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2)


def hampel(df: DataFrame, window: int = 5, limit: float = 3.0, col: str = "value", by: list[str] | None = None, order: str = "pid") -> DataFrame:
    """Replace values further than limit * 1.4826 MAD from the running median; windows are cut off at the ends.

    Flat windows (MAD 0) and NULL values stay as they are.
    """
    half = (window - 1) // 2
    w = _along(by or TRACK, order).rowsBetween(-half, half)
    out = df.withColumn("__near", F.collect_list(col).over(w)).withColumn("__med", _array_median(F.col("__near")))
    out = out.withColumn("__mad", F.lit(1.4826) * _array_median(F.transform("__near", lambda v: F.abs(v - F.col("__med")))))
    far = (F.col("__mad") > 0) & (F.abs(F.col(col) - F.col("__med")) > F.lit(float(limit)) * F.col("__mad"))
    return out.withColumn(col, F.when(far, F.col("__med")).otherwise(F.col(col))).drop("__near", "__med", "__mad")


def median_decision(df: DataFrame, window: int = 5, limit: float = 3.0, mode: str = "relative", col: str = "value", by: list[str] | None = None, order: str = "pid") -> DataFrame:
    """Replace values that differ from the running median by more than limit, or limit times the median."""
    half = (window - 1) // 2
    w = _along(by or TRACK, order).rowsBetween(-half, half)
    bound = F.abs(F.lit(float(limit)) * F.col("__med")) if mode == "relative" else F.lit(float(limit))
    out = df.withColumn("__med", F.percentile(col, F.lit(0.5)).over(w))
    return out.withColumn(col, F.when(F.abs(F.col(col) - F.col("__med")) > bound, F.col("__med")).otherwise(F.col(col))).drop("__med")


@step("despike_1D_points", "points")
def despike_points(df: DataFrame, method: str = "hampel", window_size: int = 5, threshold: float = 3.0) -> DataFrame:
    if method == "hampel":
        return hampel(df, window_size, threshold)
    return median_decision(df, window_size, threshold)


@step("despike_1D_grid", "grid")
def despike_grid(df: DataFrame, method: str = "hampel", window_size: int = 5, threshold: float = 3.0, axis: int = 0) -> DataFrame:
    by, order = (["survey_id", "ix"], "iy") if axis == 0 else (["survey_id", "iy"], "ix")
    f = hampel if method == "hampel" else median_decision
    return f(df, window_size, threshold, col="z", by=by, order=order)


def level(df: DataFrame, reference: str = "mean", config: str = "mono", percentiles: tuple[float, float] | None = None, col: str = "value", by: list[str] | None = None, overall: list[str] | None = None) -> DataFrame:
    """Bring each track's level (mono), or level and gain (multi), to the survey's.

    ``mean`` pairs with the population deviation, ``median`` with the quartiles' distance. Percentiles limit
    what statistics are taken from, by bounds of the whole survey; every value is moved.
    """
    by, overall = by or TRACK, overall or KEY
    v = F.col(col)
    if percentiles:
        df = with_aggregates(df, overall, __q0=Quantile(col, percentiles[0] / 100), __q1=Quantile(col, percentiles[1] / 100))
        v = F.when(v.between(F.col("__q0"), F.col("__q1")), v)
    df = df.withColumn("__v", v)

    def quartiles(prefix: str, keys: list[str]) -> DataFrame:
        got = group_stats(df, keys, m=Quantile("__v", 0.5), lo=Quantile("__v", 0.25), hi=Quantile("__v", 0.75))
        return got.select(*keys, F.col("m").alias(f"__{prefix}s"), (F.col("hi") - F.col("lo")).alias(f"__{prefix}g"))

    if reference == "mean":
        tracks = group_stats(df, list(dict.fromkeys([*overall, *by])), __n=F.count("__v"), __ts=F.avg("__v"), __tg=F.stddev_pop("__v"))
        whole = _pooled(tracks, overall)
        if not set(overall) <= set(by):
            tracks = group_stats(df, by, __ts=F.avg("__v"), __tg=F.stddev_pop("__v"))
        tracks = tracks.select(*by, "__ts", "__tg")
    else:
        tracks, whole = quartiles("t", by), quartiles("a", overall)
    out = matched(matched(df, tracks, by), whole, overall)
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    gain = one("__ag") / one("__tg") if config == "multi" else F.lit(1.0)
    return out.withColumn(col, (F.col(col) - F.col("__ts")) * gain + F.col("__as")).drop("__v", "__ts", "__tg", "__as", "__ag", "__q0", "__q1")


def _pooled(groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, __as, __ag): mean and population deviation of unions of groups with count __n, mean __ts and deviation __tg."""
    shape = groups.select(*by, F.col("__ts").alias("__as"), F.col("__tg").alias("__ag"))
    if (rows := few(groups)) is not None:  # known to the driver already
        pooled, members = [], {}
        for r in rows:
            members.setdefault(tuple(r[b] for b in by), []).extend([r] if r["__n"] else [])
        for key, mine in members.items():
            n = sum(r["__n"] for r in mine)
            mean = fsum(r["__n"] * r["__ts"] for r in mine) / n if n else None
            off = sqrt(fsum(r["__n"] * (r["__tg"] * r["__tg"] + (r["__ts"] - mean) * (r["__ts"] - mean)) for r in mine) / n) if n else None
            pooled.append({**dict(zip(by, key, strict=True)), "__as": mean, "__ag": off})
        return F.broadcast(local(shape, pooled))
    mean = groups.groupBy(*by).agg(F.try_divide(F.sum(F.col("__n") * F.col("__ts")), F.sum("__n")).alias("__as"))
    off = F.col("__n") * (F.pow("__tg", F.lit(2)) + F.pow(F.col("__ts") - F.col("__as"), 2))
    return settled(matched(groups, mean, by).groupBy(*by).agg(F.first("__as").alias("__as"), F.sqrt(F.try_divide(F.sum(off), F.sum("__n"))).alias("__ag")))


step("destripe_points_by_leveling", "points")(lambda df, reference="mean", config="mono", percentile_range=None: level(df, reference, config, percentile_range))
step("destripe_grid_by_leveling", "grid")(lambda df, reference="mean", config="mono", percentile_range=None: level(df, reference, config, percentile_range, "z", ["survey_id", "ix"]))
step("zero_mean_profiles", "grid")(lambda df, percentile_range=None: level(df, "mean", "mono", percentile_range, "z", ["survey_id", "ix"]))
step("zero_median_profiles", "grid")(lambda df, percentile_range=None: level(df, "median", "mono", percentile_range, "z", ["survey_id", "ix"]))


def zero_tracks(df: DataFrame, stat: str = "mean", percentiles: tuple[float, float] | None = None, col: str = "value", by: list[str] | None = None) -> DataFrame:
    """Subtract each track's mean or median (of values within the percentiles of the track)."""
    by = by or TRACK
    v = F.col(col)
    if percentiles:
        df = with_aggregates(df, by, __q0=Quantile(col, percentiles[0] / 100), __q1=Quantile(col, percentiles[1] / 100))
        v = F.when(v.between(F.col("__q0"), F.col("__q1")), v)
    out = with_aggregates(df.withColumn("__v", v), by, __s=F.avg("__v") if stat == "mean" else Quantile("__v", 0.5))
    return out.withColumn(col, F.col(col) - F.col("__s")).drop("__v", "__s", "__q0", "__q1")


step("zero_mean_tracks", "points")(lambda df, percentile_range=None: zero_tracks(df, "mean", percentile_range))
step("zero_median_tracks", "points")(lambda df, percentile_range=None: zero_tracks(df, "median", percentile_range))


def destripe_neighbours(df: DataFrame, n: int = 4, method: str = "additive", reference: str = "mean", config: str = "mono") -> DataFrame:
    """Level each grid profile (column) to the pooled cells of columns ix-n .. ix+n-1.

    n = 0 takes level 0 (and gain 1) as the reference. Means and deviations of neighbours come
    from per-column sums, medians from the neighbours' cells.
    """
    prof = ["survey_id", "ix"]
    if reference == "mean":
        cols = df.groupBy(*prof).agg(F.count("z").alias("__n"), F.sum("z").alias("__s"), F.sum(F.col("z") * F.col("z")).alias("__ss"))
        w = Window.partitionBy("survey_id").orderBy("ix").rangeBetween(-n, n - 1) if n else None
        s, g = F.try_divide(F.col("__s"), F.col("__n")), None
        var = lambda a, b, c: F.sqrt(F.greatest(F.try_divide(c, a) - F.pow(F.try_divide(b, a), 2), F.lit(0.0)))
        g = var(F.col("__n"), F.col("__s"), F.col("__ss"))
        cols = cols.withColumns({"__ts": s, "__tg": g})
        if n:
            cols = cols.withColumns({f"__w{k}": F.sum(f"__{k}").over(w) for k in ("n", "s", "ss")})
            cols = cols.withColumns({"__as": F.try_divide(F.col("__ws"), F.col("__wn")), "__ag": var(F.col("__wn"), F.col("__ws"), F.col("__wss"))})
    else:
        def quartiles(cells: DataFrame, prefix: str) -> DataFrame:
            got = group_stats(cells, prof, m=Quantile("z", 0.5), lo=Quantile("z", 0.25), hi=Quantile("z", 0.75))
            return got.select(*prof, F.col("m").alias(f"__{prefix}s"), (F.col("hi") - F.col("lo")).alias(f"__{prefix}g"))

        cols = quartiles(df, "t")
        if n:
            cols = cols.join(quartiles(df.withColumn("ix", F.explode(F.sequence(F.col("ix") - n + 1, F.col("ix") + n))), "a"), prof)
    if not n:
        cols = cols.withColumns({"__as": F.lit(0.0 if method == "additive" else 1.0), "__ag": F.lit(1.0)})
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    gain = one("__ag") / one("__tg") if config == "multi" else F.lit(1.0)
    z = F.col("z")
    new = (z - F.col("__ts")) * gain + F.col("__as") if method == "additive" else F.try_divide(z, F.col("__ts")) * F.col("__as")
    return df.join(cols.select(*prof, "__ts", "__tg", "__as", "__ag"), prof).withColumn("z", new).select(*df.columns)


def detrend_linear(df: DataFrame, position: str = "x", col: str = "value", by: list[str] | None = None) -> DataFrame:
    """Subtract each track's straight line over position."""
    both = F.col(col).isNotNull() & F.col(position).isNotNull()
    a, b = F.when(both, F.col(col)), F.when(both, F.col(position))
    out = with_aggregates(df, by or TRACK, __b=F.regr_slope(a, b), __a=F.regr_intercept(a, b), __m=F.avg(a))
    line = F.coalesce(F.col("__a") + F.col("__b") * F.col(position), F.col("__m"))
    return out.withColumn(col, F.col(col) - line).drop("__a", "__b", "__m")


def polynomial(df: DataFrame, degree: int = 3, reference: str | int = "zero", percentiles: tuple[float, float] | None = None, kind: str = "points") -> DataFrame:
    """Subtract each track's least-squares polynomial ('zero'), or bring it to the mean of all ('mean') or of the
    N tracks on each side and itself (a number N; the first and last track count on beyond the ends).

    Points are fitted over the distance from the track's first point, grid columns over iy. A track is one
    group of bounded size; fits with fewer valid values than coefficients leave the track as it is.
    """
    by, order, col = (TRACK, "pid", "value") if kind == "points" else (["survey_id", "ix"], "iy", "z")
    cols = df.columns
    if kind == "points":
        w = _along(by)
        first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("__d", F.sqrt(F.pow(F.col("x") - first("x"), 2) + F.pow(F.col("y") - first("y"), 2)))
    else:
        df = df.withColumn("__d", F.col("iy").cast("double"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        d, v = g["__d"].to_numpy(float), g[col].to_numpy(float)
        ok = np.isfinite(d) & np.isfinite(v)
        if percentiles and ok.any():
            lo, hi = np.percentile(v[ok], percentiles)
            ok &= (v >= lo) & (v <= hi)
        c = np.full(degree + 1, np.nan)
        if ok.sum() > degree and len(np.unique(d[ok])) > degree:
            scale = max(np.abs(d[ok]).max(), 1e-12)
            c = np.linalg.lstsq(np.vander(d[ok] / scale, degree + 1, increasing=True), v[ok], rcond=None)[0] / scale ** np.arange(degree + 1)
        out = {k: [g[k].iloc[0]] for k in by}
        return pd.DataFrame({**out, "__c": [c.tolist()]})

    types = dict(df.dtypes)
    coef = df.select(*by, "__d", col).groupBy(*by).applyInPandas(fit, ", ".join(f"`{k}` {types[k]}" for k in by) + ", __c array<double>")
    coef = coef.withColumn("__c", F.when(~F.exists("__c", lambda x: x.isNull() | F.isnan(x)), F.col("__c")))
    if reference == "mean":
        means = F.array(*[F.avg(F.col("__c")[k]) for k in range(degree + 1)])
        coef = with_aggregates(coef, ["survey_id"], __r=means)
    elif reference != "zero":
        n = int(reference)
        place = df.groupBy(*by).agg(F.min("pid").alias("__at")) if kind == "points" else coef.select(*by, F.col("ix").alias("__at"))
        w = Window.partitionBy("survey_id").orderBy("__at")  # one row per track
        near, all_ = w.rowsBetween(-n, n), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        left, right = F.greatest(n + 1 - F.row_number().over(w), F.lit(0)), F.greatest(n - F.count("*").over(all_) + F.row_number().over(w), F.lit(0))
        fits = coef.where("__c is not null").join(place, by)
        mean = lambda c: (F.sum(c).over(near) + left * F.first(c).over(all_) + right * F.last(c).over(all_)) / (2 * n + 1)
        coef = fits.withColumn("__r", F.array(*[mean(F.col("__c")[k]) for k in range(degree + 1)])).drop("__at")
    out = df.join(coef, by, "left")
    value = lambda c: sum((F.col(c)[k] * F.pow(F.col("__d"), F.lit(k)) for k in range(degree + 1)), F.lit(0.0))
    new = F.col(col) - value("__c") + (value("__r") if reference != "zero" else F.lit(0.0))
    return out.withColumn(col, F.coalesce(new, F.col(col))).select(*cols)


step("destripe_points_by_polynomial", "points")(lambda df, degree=3, reference_poly="zero", percentile_range=None: polynomial(df, degree, reference_poly, percentile_range))
step("destripe_grid_by_polynomial", "grid")(lambda df, degree=3, reference_poly="zero", percentile_range=None: polynomial(df, degree, reference_poly, percentile_range, "grid"))
step("detrend_grid", "grid")(lambda df, order=1: polynomial(df, order, "zero", None, "grid"))


# runs, sessions, fills ------------------------------------------------------


def interpolate_segments(df: DataFrame, digits: int = 2, by: list[str] | None = None) -> DataFrame:
    """x and y equally spaced from a segment's first to its last point, halves to even."""
    w = _along(by or ["survey_id", "segment"])
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k, n = F.row_number().over(w) - 1, F.count("*").over(full)
    f = F.when(n > 1, k / (n - 1)).otherwise(0.0)
    line = lambda c: F.bround(F.first(c).over(full) + f * (F.last(c).over(full) - F.first(c).over(full)), digits)
    return df.withColumns({"x": line("x"), "y": line("y")})


def seconds_of_day(text: str | Column, sep: str = ":") -> Column:
    """H:M:S as seconds, to milliseconds; NULL where it doesn't parse."""
    p = F.split(F.col(text) if isinstance(text, str) else text, sep)
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.bround(part(1) * 3600 + part(2) * 60 + part(3), 3)


def gap_sessions(df: DataFrame, factor: float = 5.0, time: str = "seconds", by: list[str] | None = None) -> DataFrame:
    """Adds ``segment``, from 1: a new one where the gap exceeds factor times the group's median gap."""
    by = by or KEY
    w = _along(by)
    filled = F.last(time, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("__t", filled).withColumn("__gap", F.col("__t") - F.lag("__t").over(w))
    out = with_aggregates(out, by, __m=Quantile("__gap", 0.5))
    out = out.withColumn("__new", F.coalesce((F.col("__gap") > F.lit(factor) * F.col("__m")).cast("int"), F.lit(0)))
    return out.withColumn("segment", (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("__t", "__gap", "__m", "__new")


def detect_bases(df: DataFrame, limit: float = 2.0) -> DataFrame:
    """Adds ``base`` and ``profile`` numbers (0: not one) by the distance of segments' centroids to the first one's."""
    mid = df.groupBy("survey_id", "segment").agg(F.bround(F.avg("x"), 2).alias("cx"), F.bround(F.avg("y"), 2).alias("cy"))
    w = Window.partitionBy("survey_id").orderBy("segment")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    away = F.sqrt(F.pow(F.col("cx") - F.first("cx").over(full), 2) + F.pow(F.col("cy") - F.first("cy").over(full), 2))
    mid = mid.withColumn("is_base", (away <= F.lit(limit)) & (F.count("*").over(full) > 1))
    run = lambda flag: F.sum(flag.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    mid = mid.withColumns({"base": F.when(F.col("is_base"), run(F.col("is_base"))).otherwise(0).cast("int"), "profile": F.when(~F.col("is_base"), run(~F.col("is_base"))).otherwise(0).cast("int")})
    return df.join(mid.select("survey_id", "segment", "base", "profile"), ["survey_id", "segment"])


def profiles_by_x(df: DataFrame, col: str = "x", by: list[str] | None = None) -> DataFrame:
    """Adds ``base``, ``profile`` (0: not one), ``bp`` (runs so far) and ``seconds`` (-1) to readings without satellite fixes.

    A new run begins where the coordinate changes; negative ones mark bases. A missing coordinate stays in the run before it.
    One task holds what shares ``by``: for large surveys name a file or session there.
    """
    w = _along(by or KEY)
    to_here, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    x = F.col(col)
    out = df.withColumns({"__x": F.last(x, ignorenulls=True).over(to_here), "__was": F.last(x, ignorenulls=True).over(before)})
    new = x.isNotNull() & ~x.eqNullSafe(F.col("__was"))
    out = out.withColumns({k: F.sum((new & sign).cast("int")).over(to_here).cast("int") for k, sign in (("__b", x < 0), ("__p", x >= 0))})
    in_base = F.coalesce(F.col("__x") < 0, F.lit(False))
    out = out.withColumns({"base": F.when(in_base, F.col("__b")).otherwise(0), "profile": F.when(in_base, 0).otherwise(F.col("__p")), "bp": F.col("__b") + F.col("__p"), "seconds": F.lit(-1.0)})
    return out.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("base", "profile", "bp")}).drop("__x", "__was", "__b", "__p")


def sliding_windows(df: DataFrame, n: int, col: str = "value", by: list[str] | None = None) -> DataFrame:
    """(keys, pid, window): the n values from each row on, complete windows only."""
    by = by or TRACK
    ahead = _along(by).rowsBetween(0, n - 1)
    cell = F.struct(F.col(col).alias("v"))  # missing values keep their places
    return df.withColumn("__w", F.collect_list(cell).over(ahead)).where(F.size("__w") == n).select(*by, "pid", F.transform("__w", lambda s: s["v"]).alias("window"))


def split_bases(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("base <> 0"), df.where("profile <> 0")


def renumber(df: DataFrame, col: str = "track", to: str = "number", by: list[str] | None = None) -> DataFrame:
    """Dense numbers from 1 in order of first appearance."""
    by = by or KEY
    first = df.groupBy(*by, col).agg(F.min("pid").alias("__first"))
    first = first.withColumn(to, F.dense_rank().over(Window.partitionBy(*by).orderBy("__first")))
    return df.join(first.drop("__first"), [*by, col])


def fill_linear(df: DataFrame, col: str, position: str, by: list[str], ends: str = "constant", empty: float | None = None) -> DataFrame:
    """Fill NULLs by straight lines between neighbours; beyond the ends by the nearest value, or leave them ('none')."""
    w = Window.partitionBy(*by).orderBy(position)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(col).isNotNull(), F.col(position))
    v0, v1 = F.last(col, ignorenulls=True).over(back), F.first(col, ignorenulls=True).over(ahead)
    p0, p1 = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
    line = v0 + (v1 - v0) * F.try_divide((F.col(position) - p0).cast("double"), (p1 - p0).cast("double"))
    new = F.coalesce(F.col(col), line, *([v0, v1] if ends == "constant" else []), *([F.lit(empty)] if empty is not None else []))
    return df.withColumn(col, new)


def spread_repeats(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Repeated positions are spread evenly up to the next change (a slow satellite receiver)."""
    w = Window.partitionBy(*by).orderBy("pid")
    change = None
    for c in cols:
        d = ~F.col(c).eqNullSafe(F.lag(c).over(w))
        change = d if change is None else change | d
    out = df.withColumn("__new", F.when(F.lag("pid").over(w).isNull() | change, 1).otherwise(0)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = out.groupBy(*by, "__run").agg(F.count("*").alias("__n"), F.min("pid").alias("__p0"), *[F.first(c).alias(f"__v_{c}") for c in cols])
    rw = Window.partitionBy(*by).orderBy("__run")
    runs = runs.withColumns({f"__w_{c}": F.lead(f"__v_{c}").over(rw) for c in cols})
    out = out.join(runs, [*by, "__run"])
    k = F.row_number().over(Window.partitionBy(*by, "__run").orderBy("pid")) - 1
    out = out.withColumn("__k", k)
    for c in cols:
        out = out.withColumn(c, F.col(f"__v_{c}") + F.coalesce((F.col(f"__w_{c}") - F.col(f"__v_{c}")) * F.col("__k") / F.col("__n"), F.lit(0.0)))
    return out.select(*df.columns)


def regress_fill(df: DataFrame, cols: list[str], by: list[str], replace_all: bool = False) -> DataFrame:
    """Fill NULLs (or replace all) by each profile's straight line over the row's place; one known point is not enough."""
    w = Window.partitionBy(*by).orderBy("pid")
    out = df.withColumn("__i", (F.row_number().over(w) - 1).cast("double"))
    aggs = {}
    for c in cols:
        i = F.when(F.col(c).isNotNull(), F.col("__i"))
        aggs |= {f"__a_{c}": F.regr_intercept(c, i), f"__b_{c}": F.regr_slope(c, i)}
    out = with_aggregates(out, by, **aggs)
    for c in cols:
        line = F.col(f"__a_{c}") + F.col(f"__b_{c}") * F.col("__i")
        out = out.withColumn(c, F.coalesce(line, F.col(c)) if replace_all else F.coalesce(F.col(c), line))
    return out.select(*df.columns)


def offset_along_track(df: DataFrame, along: float, across: float, digits: int = 4, by: list[str] | None = None) -> DataFrame:
    """Move points by a sensor's offset along and across the local direction of travel."""
    w = _along(by or TRACK)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    size = F.sqrt(dx * dx + dy * dy)
    out = df.withColumns({"__ux": F.try_divide(dx, size), "__uy": F.try_divide(dy, size)})
    mean = lambda c: (F.coalesce(F.col(c), F.lead(c).over(w)) + F.coalesce(F.lead(c).over(w), F.col(c))) / 2
    out = out.withColumns({"__mx": mean("__ux"), "__my": mean("__uy")})
    new_x = F.bround(F.col("x") + F.lit(along) * F.col("__mx") - F.lit(across) * F.col("__my"), digits)
    new_y = F.bround(F.col("y") + F.lit(along) * F.col("__my") + F.lit(across) * F.col("__mx"), digits)
    return out.withColumns({"__nx": F.coalesce(new_x, F.col("x")), "__ny": F.coalesce(new_y, F.col("y"))}).drop("x", "y").withColumnsRenamed({"__nx": "x", "__ny": "y"}).select(*df.columns)


def mark_gaps(df: DataFrame, factor: float = 2.0, by: list[str] | None = None, position: str = "x", col: str = "value") -> DataFrame:
    """Adds rows with NULL values in the middle of gaps over 2 * factor times the smallest gap; their pid is NULL."""
    by = by or TRACK
    w = Window.partitionBy(*by).orderBy(position)
    gaps = df.withColumn("__gap", F.lead(position).over(w) - F.col(position))
    least = gaps.where("__gap > 0").groupBy(*by).agg(F.min("__gap").alias("__d"))
    far = gaps.join(least, by).where(F.col("__gap") > F.lit(2 * factor) * F.col("__d"))
    types = dict(df.dtypes)
    fresh = {position: F.col(position) + F.col("__gap") / 2}
    keep = {*by, position}
    return df.unionByName(far.select(*[fresh.get(c, F.col(c)).alias(c) if c in keep else F.lit(None).cast(types[c]).alias(c) for c in df.columns]))


def shift_along_trajectory(df: DataFrame, shift: float) -> DataFrame:
    """Slide every point of a track by a distance along its own path, going on straight beyond the ends."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid").reset_index(drop=True)
        x, y = g["x"].to_numpy(float), g["y"].to_numpy(float)
        d = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))))
        u, at = np.unique(d, return_index=True)
        if len(u) > 1:
            for c, v in (("x", x), ("y", y)):
                w, t = v[at], d + shift
                new = np.interp(t, u, w)
                low, high = t < u[0], t > u[-1]
                new[low] = w[0] + (t[low] - u[0]) * (w[1] - w[0]) / (u[1] - u[0])
                new[high] = w[-1] + (t[high] - u[-1]) * (w[-1] - w[-2]) / (u[-1] - u[-2])
                g[c] = new
        return g

    return df.groupBy(*TRACK).applyInPandas(work, df.schema)


def resample(df: DataFrame, spacing: float, by: list[str] | None = None) -> DataFrame:
    """(keys, k, distance, value): values at 0, spacing, 2 spacing, ... below each track's length, linear in between."""
    by = by or TRACK
    d = distance_along_track(df, by).where(F.col("value").isNotNull())
    w = Window.partitionBy(*by).orderBy("distance", "pid")
    legs = d.withColumns({"__d1": F.lead("distance").over(w), "__v1": F.lead("value").over(w)}).where("__d1 > distance")
    k0, k1 = F.ceil(F.col("distance") / F.lit(spacing)), F.ceil(F.col("__d1") / F.lit(spacing)) - 1
    legs = legs.where(k0 <= k1).withColumn("k", F.explode(F.sequence(k0, k1)))
    at = F.col("k") * F.lit(spacing)
    return legs.select(*by, "k", at.alias("at"), (F.col("value") + (F.col("__v1") - F.col("value")) * (at - F.col("distance")) / (F.col("__d1") - F.col("distance"))).alias("v")).withColumnsRenamed({"at": "distance", "v": "value"})


def destagger_points(df: DataFrame, spacing: float = 0.5) -> DataFrame:
    """Slide every second track along its path by the lag at which it fits its predecessor best.

    The lag is that of the highest demeaned correlation of the two tracks resampled at ``spacing``, over their
    common length; ties go to the smallest lag.
    """
    from .correlation import best_shift

    r = resample(df, spacing)
    order = df.groupBy("survey_id", "track").agg(F.min("pid").alias("__p")).withColumn("rank", F.row_number().over(Window.partitionBy("survey_id").orderBy("__p")) - 1)
    arr = r.groupBy("survey_id", "track").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: s["value"]).alias("v")).join(order, ["survey_id", "track"])
    other = arr.select("survey_id", (F.col("rank") + 1).alias("rank"), F.col("v").alias("u"))
    pairs = arr.where(F.col("rank") % 2 == 1).join(other, ["survey_id", "rank"])

    @F.pandas_udf("double")
    def shift(u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([best_shift(np.asarray(a, float), np.asarray(b, float))[0] * spacing for a, b in zip(u, v, strict=True)])

    lags = pairs.select("survey_id", "track", shift("u", "v").alias("__shift"))
    out = df.join(lags, ["survey_id", "track"], "left").withColumn("__shift", F.coalesce("__shift", F.lit(0.0)))
    names = df.columns

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid").reset_index(drop=True)
        s = float(g["__shift"].iloc[0])
        x, y = g["x"].to_numpy(float), g["y"].to_numpy(float)
        d = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))))
        u, at = np.unique(d, return_index=True)
        if s and len(u) > 1:
            for c, v in (("x", x), ("y", y)):
                w, t = v[at], d + s
                new = np.interp(t, u, w)
                new[t < 0] = w[0] + t[t < 0] * (w[1] - w[0]) / (u[1] - u[0])
                new[t > u[-1]] = w[-1] + (t[t > u[-1]] - u[-1]) * (w[-1] - w[-2]) / (u[-1] - u[-2])
                g[c] = new
        return g[names]

    return out.groupBy(*TRACK).applyInPandas(work, df.schema)
