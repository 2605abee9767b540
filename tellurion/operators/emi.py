"""Multi-channel electromagnetic logs: time, bases, drift, channels, calibration, devices.

Long form: file_id, pid, seconds, x, y, segment, base, profile, bp, channel, cond, inph.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_bracket
from .points import fuse, median
from .tracks import offset_along_track, seconds_of_day

#: Coil configurations of devices.
CONFIGURATIONS = ["HCP", "VCP", "VVCP", "PRP_CS", "PRP_DEM", "PAR", "COAX_H", "COAX_P", "CUS"]


def with_seconds(df: DataFrame, time: str = "time", date: str | None = "date", by: list[str] | None = None) -> DataFrame:
    """Adds ``seconds`` of the day plus a day for each further distinct date of the file."""
    by = by or ["file_id"]
    s = seconds_of_day(time)
    if date and date in df.columns:
        days = df.select(*by, date).distinct().withColumn("__day", F.dense_rank().over(Window.partitionBy(*by).orderBy(date)) - 1)
        return df.join(days, [*by, date], "left").withColumn("seconds", s + F.coalesce("__day", F.lit(0)) * 86400).drop("__day")
    return df.withColumn("seconds", s)


def valid_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.lit(False)) & F.try_to_timestamp(c, F.lit("MM/dd/yyyy")).isNotNull()


def change_date(df: DataFrame, date: str) -> DataFrame:
    import datetime

    datetime.datetime.strptime(date, "%m/%d/%Y")
    return df.withColumn("date", F.lit(date))


def synthetic_bases(df: DataFrame, low_only: bool = False, by: list[str] | None = None) -> DataFrame:
    """(keys, seconds, cond, inph) of each base: medians above and below the middle of the 5 and 95 percent
    conductivities; the mean of both, or the lower ones alone. Rounded to 2 decimals."""
    by = by or ["file_id", "base", "channel"]
    rows = df.where("base <> 0")
    cut = rows.groupBy(*by).agg(((F.percentile("cond", F.lit(0.05)) + F.percentile("cond", F.lit(0.95))) / 2).alias("__t"))
    joined = rows.join(cut, by)
    up, low = F.col("cond") > F.col("__t"), F.col("cond") <= F.col("__t")
    got = joined.groupBy(*by).agg(
        F.bround(median("seconds"), 2).alias("seconds"), *[median(F.when(w, F.col(c))).alias(f"__{c}_{k}") for c in ("cond", "inph") for k, w in (("sup", up), ("inf", low))]
    )
    mix = lambda c: F.bround(F.col(f"__{c}_inf") if low_only else F.coalesce((F.col(f"__{c}_sup") + F.col(f"__{c}_inf")) / 2, F.col(f"__{c}_inf"), F.col(f"__{c}_sup")), 2)
    return got.select(*by, "seconds", mix("cond").alias("cond"), mix("inph").alias("inph"))


def fuse_bases(first: DataFrame, second: DataFrame, profiles: DataFrame, low_only: bool = False) -> DataFrame:
    """Bases of two files, one before and one after the profiles: numbered 1 and 2, with bp 0 and last + 1."""
    last = profiles.agg(F.coalesce(F.max("bp"), F.lit(0)).alias("__last"))
    a = first.withColumns({"base": F.lit(1), "bp": F.lit(0)})
    b = second.crossJoin(last).withColumns({"base": F.lit(2), "bp": (F.col("__last") + 1).cast("int")}).drop("__last")
    return synthetic_bases(fuse(a, b.select(*a.columns)), low_only, ["base", "bp", "channel"])


def correct_channels(profiles: DataFrame, bases: DataFrame, diff: bool = True) -> DataFrame:
    """Take the drift of each file and channel, straight between bases, off both results, relative to the first base."""
    by = ["file_id", "channel"]
    b = bases.select(*by, "seconds", F.col("seconds").alias("t"), F.col("cond").alias("c"), F.col("inph").alias("i"))
    firsts = bases.groupBy(*by).agg(F.min_by("cond", "seconds").alias("__c0"), F.min_by("inph", "seconds").alias("__i0"))
    out = asof_bracket(profiles, b, by, "seconds", ["t", "c", "i"]).join(firsts, by, "left")
    f = F.try_divide(F.col("seconds") - F.col("t_before"), F.col("t_after") - F.col("t_before"))
    for col, k, ref in (("cond", "c", "__c0"), ("inph", "i", "__i0")):
        lev = F.coalesce(F.col(f"{k}_before") + (F.col(f"{k}_after") - F.col(f"{k}_before")) * f, f"{k}_before", f"{k}_after")
        new = F.col(col) - (lev - F.col(ref)) if diff else F.try_divide(F.col(col) * F.col(ref), lev)
        out = out.withColumn(col, F.coalesce(new, F.col(col)))
    return out.select(*profiles.columns)


def channel_offset(positions: list[float], gps: float, channel: int) -> float:
    """Offset along the boom of a channel's middle: gps - (position of its coil - last) / 2."""
    return gps - (positions[channel] - positions[-1]) / 2


def place_channels(df: DataFrame, along: list[float], across: list[float], gps: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Positions of each channel's middle, by the local direction of travel of its profile."""
    parts = None
    for k in range(len(along)):
        one = df.where(F.col("channel") == k + 1)
        one = offset_along_track(one, channel_offset(along, gps[0], k), channel_offset(across, gps[1], k), by=["file_id", "profile"])
        parts = one if parts is None else parts.unionByName(one)
    return parts


def pseudo_profiles(df: DataFrame, tn: int = 10, factor: float = 20.0, least: int = 8, by: list[str] | None = None) -> DataFrame:
    """Adds ``profile``: numbers of passes across the straight line through a file's points.

    Local minima of the distance to the line are the middles of passes, if they are no further than ``factor``
    times the mean of the ``tn`` smallest; middles nearer than ``least`` points to the one before join it. Each point
    belongs to the middle nearest by order. A file is one bounded group for the merge of middles alone.
    """
    by = by or ["file_id"]
    line = df.groupBy(*by).agg(F.regr_slope("y", "x").alias("__b"), F.regr_intercept("y", "x").alias("__a"))
    w = Window.partitionBy(*by).orderBy("pid")
    d = df.join(line, by).withColumn("__d", F.abs(F.col("y") - F.col("__a") - F.col("__b") * F.col("x")) / F.sqrt(1 + F.col("__b") ** 2)).withColumn("__k", F.row_number().over(w))
    low = d.withColumns({"__p": F.lag("__d").over(w), "__n": F.lead("__d").over(w)}).where("(__p is null or __d < __p) and (__n is null or __d <= __n)")
    small = low.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__d", "__k"))).where(F.col("__r") <= tn).groupBy(*by).agg((F.avg("__d") * factor).alias("__lim"))
    low = low.join(small, by).where("__d <= __lim").select(*by, "__k", "__d")

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("__k")
        kept: list[list[float]] = []
        for k, dist in zip(g["__k"], g["__d"], strict=True):
            if kept and k - kept[-1][0] < least:
                if dist < kept[-1][1]:
                    kept[-1] = [k, dist]
            else:
                kept.append([k, dist])
        return pd.DataFrame({**{c: g[c].iloc[0] for c in by}, "__m": [int(k) for k, _ in kept], "profile": range(1, len(kept) + 1)})

    types = dict(df.dtypes)
    mids = low.groupBy(*by).applyInPandas(merge, ", ".join(f"{c} {types[c]}" for c in by) + ", __m bigint, profile int")
    ends = mids.withColumn("__to", F.lead("__m").over(Window.partitionBy(*by).orderBy("__m"))).withColumn("__from", F.lag("__m").over(Window.partitionBy(*by).orderBy("__m")))
    ends = ends.select(*by, "profile", F.coalesce(F.floor((F.col("__from") + F.col("__m")) / 2) + 1, F.lit(1)).alias("__k0"))
    base = d.select(*df.columns, "__k").unionByName(ends.select(*by, F.col("__k0").alias("__k"), F.col("profile").alias("__profile")), allowMissingColumns=True)
    run = Window.partitionBy(*by).orderBy("__k", F.col("__profile").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return base.withColumn("profile", F.last("__profile", ignorenulls=True).over(run)).where("pid is not null").select(*df.columns, "profile")


def calibrate(df: DataFrame, coefficients: list[float], col: str = "inph", to: str = "sigma") -> DataFrame:
    """Conductivity from quadrature by a cubic without constant in thousands; values that aren't positive are NULL."""
    q = F.col(col) / 1000
    s = sum((F.lit(float(c)) * F.pow(q, F.lit(k + 1)) for k, c in enumerate(coefficients)), F.lit(0.0))
    return df.withColumn(to, F.when(s > 0, s))


def fit_relation(x: np.ndarray, y: np.ndarray, kind: str = "linear") -> list[float]:
    """Coefficients, lowest first: linear least squares, a Huber cubic ('poly_3'), or the cubic whose inverse fits ('inverse_3')."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if kind == "inverse_3":
        return fit_relation(y, x, "poly_3")
    degree = 1 if kind == "linear" else 3
    m = np.vander(x, degree + 1, increasing=True)
    w = np.ones(len(x))
    c = np.linalg.lstsq(m, y, rcond=None)[0]
    for _ in range(50 if kind == "poly_3" else 0):
        r = np.abs(y - m @ c)
        scale = 1.4826 * np.median(r)
        if scale <= 1e-12:
            break
        w = np.minimum(1.0, 1.35 * scale / np.maximum(r, 1e-300))
        new = np.linalg.lstsq(m * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        if np.allclose(new, c, rtol=1e-10, atol=1e-12):
            break
        c = new
    return [float(v) for v in c]


def relation(df: DataFrame, x: str = "cond", y: str = "inph", by: list[str] | None = None) -> DataFrame:
    """(keys, slope, intercept) of the straight relation of two results."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(y)), F.when(both, F.col(x))
    return df.groupBy(*(by or ["channel"])).agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"))


def device(app_id: int, name: str, config: str, gps: bool, gps_dec: tuple[float, float], tr_l: list[float], tr_t: list[float], height: float, freq: list[float], bucking_coil: int = 0) -> dict:
    """A checked device record; coil distances are sqrt(l^2 + t^2)."""
    if config not in CONFIGURATIONS:
        raise ValueError(f"config must be one of {CONFIGURATIONS}")
    if len(tr_l) != len(tr_t) or len(freq) != len(tr_l):
        raise ValueError("a device has one pair of coil offsets and one frequency per channel")
    tr_l, tr_t, freq = ([float(v) for v in part] for part in (tr_l, tr_t, freq))
    return {"app_id": app_id, "app_name": name, "config": config, "gps": gps, "gps_dec": [float(v) for v in gps_dec], "nb_channels": len(tr_l), "tr_l": tr_l, "tr_t": tr_t, "tr": [round(math.hypot(a, b), 2) for a, b in zip(tr_l, tr_t, strict=True)], "height": float(height), "freq_list": freq, "bucking_coil": bucking_coil}


DEVICES = "app_id int, app_name string, config string, gps boolean, gps_dec array<double>, nb_channels int, tr_l array<double>, tr_t array<double>, tr array<double>, height double, freq_list array<double>, bucking_coil int"


def add_device(devices: DataFrame, record: dict) -> DataFrame:
    """Adds a record, or replaces the one of its app_id."""
    row = devices.sparkSession.createDataFrame([record], DEVICES)
    return devices.where(F.col("app_id") != record["app_id"]).unionByName(row)


def remove_device(devices: DataFrame, app_id: int) -> DataFrame:
    return devices.where(F.col("app_id") != app_id)


def with_constants(devices: DataFrame, constants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(devices with their constants, devices that lack them), by configuration, distances, height and frequencies."""
    keys = ["config", "tr", "height", "freq_list"]
    return devices.join(constants, keys), devices.join(constants, keys, "left_anti")


def process(df: DataFrame, factor: float = 5.0, base_distance: float = 2.0, low_only: bool = False) -> DataFrame:
    """From readings in long form (file_id, pid, seconds, x, y, channel, cond, inph) to drift-corrected profiles:
    sessions by gaps, bases by distance to the first session, synthetic bases, correction of both results."""
    from .tracks import detect_bases, gap_sessions

    fixes = df.groupBy("file_id", "pid").agg(F.first("seconds").alias("seconds"), F.first("x").alias("x"), F.first("y").alias("y")).withColumn("survey_id", F.col("file_id").cast("string"))
    fixes = detect_bases(gap_sessions(fixes, factor), base_distance)
    tagged = df.join(fixes.select("file_id", "pid", "segment", "base", "profile"), ["file_id", "pid"])
    bases = synthetic_bases(tagged, low_only)
    return correct_channels(tagged.where("profile <> 0"), bases)


def to_long(df: DataFrame, channels: list[int], cond: str = "Cond.{k}[mS/m]", inph: str = "Inph.{k}[ppt]") -> DataFrame:
    """Wide channel columns as rows (channel, cond, inph)."""
    keep = [c for c in df.columns if not any(c in (cond.format(k=k), inph.format(k=k)) for k in channels)]
    parts = F.array(*[F.struct(F.lit(k).alias("channel"), F.col(f"`{cond.format(k=k)}`").alias("cond"), F.col(f"`{inph.format(k=k)}`").alias("inph")) for k in channels])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(parts))


def to_wide(df: DataFrame, keys: list[str], channels: list[int]) -> DataFrame:
    got = df.groupBy(*keys).pivot("channel", channels).agg(F.first("cond").alias("cond"), F.first("inph").alias("inph"))
    return got


def switch_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(*[F.col(f"`{b if c == a else a if c == b else c}`").alias(c) for c in df.columns])


def keep_columns(df: DataFrame, columns: list[str], keep: bool = True) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in df.columns if (c in columns) == keep])


def shift_header(df: DataFrame, column: str) -> DataFrame:
    """Drop a bogus column's name: later names move one place left, the last column is lost."""
    i = df.columns.index(column)
    names = df.columns[:i] + df.columns[i + 1 :]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns[: len(names)], names, strict=True)])
