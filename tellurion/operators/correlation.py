"""Correlation of neighbouring profiles and destaggering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.model import step

from .statistics import Quantile, with_aggregates

PROFILE = ["survey_id", "ix"]


def correlation_map(df: DataFrame, percentile_range: tuple[float, float] | None = None) -> DataFrame:
    """(survey_id, ix, lag, r): each column against its left neighbour, of values within the survey's percentiles.

    Rows where both are valid are closed up; products are summed by lag and divided by both population
    deviations and their number. Values are not demeaned. One task holds a column whole.
    """
    if percentile_range:
        df = with_aggregates(df, ["survey_id"], __q0=Quantile("z", percentile_range[0] / 100), __q1=Quantile("z", percentile_range[1] / 100))
        df = df.where(F.col("z").between(F.col("__q0"), F.col("__q1"))).drop("__q0", "__q1")
    left = df.select("survey_id", (F.col("ix") + 1).alias("ix"), "iy", F.col("z").alias("u"))
    both = df.join(left, ["survey_id", "ix", "iy"]).where("z is not null and u is not null")

    def lags(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("iy")
        z, u = g["z"].to_numpy(float), g["u"].to_numpy(float)
        n, d = len(g), g["z"].std(ddof=0) * g["u"].std(ddof=0)
        if n < 256 or not (np.isfinite(z).all() and np.isfinite(u).all()):
            s = np.correlate(z, u, "full")
        else:
            size = 1 << (2 * n - 1).bit_length()
            s = np.fft.irfft(np.fft.rfft(z, size) * np.fft.rfft(u[::-1], size), size)[: 2 * n - 1]
        r = s / (d * n) if d else np.full(2 * n - 1, np.nan)
        return pd.DataFrame({"survey_id": g["survey_id"].iloc[0], "ix": g["ix"].iloc[0], "lag": np.arange(1 - n, n), "r": r, "flat": not d})

    out = both.select(*PROFILE, "iy", "z", "u").groupBy(*PROFILE).applyInPandas(lags, "survey_id string, ix int, lag int, r double, flat boolean")
    return out.select(*PROFILE, "lag", F.when(~F.col("flat"), F.col("r")).alias("r"))


def correlation_sum(df: DataFrame, percentile_range: tuple[float, float] | None = None) -> DataFrame:
    return correlation_map(df, percentile_range).groupBy("survey_id", "lag").agg(F.sum("r").alias("r"))


def peak_lag(df: DataFrame) -> DataFrame:
    """Lag of the highest summed correlation; of equals the smallest."""
    return correlation_sum(df).groupBy("survey_id").agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("lag"))


def best_shift(u: np.ndarray, v: np.ndarray) -> tuple[int, float]:
    """(lag of the best demeaned correlation, Pearson's r after rolling); (0, 0) under three valid pairs."""
    n = min(len(u), len(v))
    u, v = u[:n], v[:n]
    ok = np.isfinite(u) & np.isfinite(v)
    u, v = u[ok], v[ok]
    if len(u) < 3 or u.std() == 0 or v.std() == 0:
        return 0, 0.0
    c = np.correlate(u - u.mean(), v - v.mean(), "full")
    lag = int(np.argmax(c)) - (len(v) - 1)
    return lag, float(np.corrcoef(u, np.roll(v, lag))[0, 1])


@step("destagger_grid_by_correlation", "grid")
def destagger(df: DataFrame, max_shift: int = 10, min_correlation: float = 0.4, uniform: bool = False, axis: str = "x", fill: bool = False) -> DataFrame:
    """Shift every second profile to fit the mean of its neighbours.

    The lag of the highest standardised correlation within max_shift wins, the smallest among equals, if it
    reaches min_correlation. ``uniform`` applies the lag of the highest summed correlation to all. Profiles are
    rolled around, or with fill shifted with NULLs behind them. axis 'y' takes rows as profiles.
    """
    p, q = ("ix", "iy") if axis == "x" else ("iy", "ix")
    cells = df.select("survey_id", F.col(p).alias("p"), F.col(q).alias("q"), "z")
    side = lambda d: cells.select("survey_id", (F.col("p") + d).alias("p"), "q", F.col("z").alias(f"n{'l' if d > 0 else 'r'}"))
    odd = cells.where("p % 2 = 1").join(side(1), ["survey_id", "p", "q"], "left").join(side(-1), ["survey_id", "p", "q"], "left")
    odd = odd.withColumn("m", F.coalesce((F.col("nl") + F.col("nr")) / 2, "nl", "nr"))
    arr = odd.groupBy("survey_id", "p").agg(F.array_sort(F.collect_list(F.struct("q", "z", "m"))).alias("a"))

    def scores(z: np.ndarray, m: np.ndarray) -> list[float]:
        ok = np.isfinite(z) & np.isfinite(m)
        out = []
        if ok.sum() < 3 or z[ok].std() == 0 or m[ok].std() == 0:
            return [0.0] * (2 * max_shift + 1)
        a, b = np.where(ok, (z - z[ok].mean()) / z[ok].std(), 0.0), np.where(ok, (m - m[ok].mean()) / m[ok].std(), 0.0)
        for lag in range(-max_shift, max_shift + 1):
            out.append(float(np.dot(np.roll(a, lag) if abs(lag) < len(a) else a * 0, b) / ok.sum()))
        return out

    @F.pandas_udf("array<double>")
    def curve(z: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([scores(np.array(a, float), np.array(b, float)) for a, b in zip(z, m, strict=True)])

    parts = lambda k: F.transform("a", lambda s: s[k])
    c = arr.select("survey_id", "p", F.posexplode(curve(parts("z"), parts("m"))).alias("k", "r")).withColumn("lag", F.col("k") - max_shift)
    if uniform:
        best = c.groupBy("survey_id", "lag").agg(F.avg("r").alias("r")).groupBy("survey_id").agg(F.max(F.struct("r", (-F.col("lag")).alias("l"))).alias("b"))
        lags = arr.select("survey_id", "p").join(best, "survey_id")
    else:
        lags = c.groupBy("survey_id", "p").agg(F.max(F.struct("r", (-F.col("lag")).alias("l"))).alias("b"))
    lags = lags.where(F.col("b.r") >= F.lit(min_correlation)).select("survey_id", "p", (-F.col("b.l")).alias("lag"))
    sizes = cells.groupBy("survey_id").agg((F.max("q") + 1).alias("n"))
    out = cells.join(lags, ["survey_id", "p"], "left").join(sizes, "survey_id").withColumn("lag", F.coalesce("lag", F.lit(0)))
    to = F.col("q") + F.col("lag")
    if fill:
        kept = out.withColumn("to", to).where("to >= 0 and to < n").select("survey_id", "p", F.col("to").alias("q"), "z")
        out = cells.select("survey_id", "p", "q").join(kept, ["survey_id", "p", "q"], "left")
    else:
        out = out.withColumn("q", F.pmod(to, F.col("n")))
    return out.select("survey_id", F.col("q" if axis == "x" else "p").cast("int").alias("iy"), F.col("p" if axis == "x" else "q").cast("int").alias("ix"), "z")


def inversions(ranks: np.ndarray) -> int:
    """Pairs out of order, counted while sorting by merging."""
    n, top, width, found = len(ranks), int(ranks.max(initial=0)) + 1, 1, 0
    a = np.full(1 << max(n - 1, 0).bit_length(), top)
    a[:n] = ranks
    while width < len(a):
        halves = a.reshape(-1, 2, width)
        block = np.arange(len(halves))[:, None]
        left, right = (halves[:, 0] + block * (top + 1)).ravel(), (halves[:, 1] + block * (top + 1)).ravel()
        before = np.searchsorted(left, right, "right").reshape(len(halves), width)  # all of earlier blocks, and those of its own not above
        found += int(((block + 1) * width - before).sum())
        a, width = np.sort(a.reshape(-1, 2 * width), 1).ravel(), 2 * width
    return found


def kendall(z: np.ndarray, u: np.ndarray) -> float | None:
    """Tau-a: pairs in the same order less pairs in opposite order, of all; ties count for neither. None below two values."""
    n = len(z)
    if n < 2:
        return None
    z, u = np.unique(z, return_inverse=True)[1], np.unique(u, return_inverse=True)[1]
    tied = lambda k: int((k * (k - 1) // 2).sum())
    pairs = n * (n - 1) // 2
    both = np.unique(z.astype(np.int64) * n + u, return_counts=True)[1]
    unlike = inversions(u[np.lexsort((u, z))])
    alike = pairs - tied(np.bincount(z)) - tied(np.bincount(u)) + tied(both) - unlike
    return (alike - unlike) / pairs


def ranked_correlation(df: DataFrame, method: str = "pearson") -> DataFrame:
    """(survey_id, ix, r) of each column with its left neighbour: pearson, spearman (mean ranks) or kendall (tau-a; one task holds a column whole)."""
    left = df.select("survey_id", (F.col("ix") + 1).alias("ix"), "iy", F.col("z").alias("u"))
    both = df.join(left, ["survey_id", "ix", "iy"]).where("z is not null and u is not null").select(*PROFILE, "iy", "z", "u")
    if method == "pearson":
        return both.groupBy(*PROFILE).agg(F.corr("z", "u").alias("r"))
    if method == "spearman":
        from pyspark.sql import Window

        for c in ("z", "u"):
            w = Window.partitionBy(*PROFILE).orderBy(c)
            mean = F.rank().over(w) + (F.count("*").over(Window.partitionBy(*PROFILE, c)) - 1) / 2
            both = both.withColumn(f"r{c}", mean)
        return both.groupBy(*PROFILE).agg(F.corr("rz", "ru").alias("r"))

    def tau(g: pd.DataFrame) -> pd.DataFrame:
        out = kendall(g["z"].to_numpy(float), g["u"].to_numpy(float))
        return pd.DataFrame({"survey_id": [g["survey_id"].iloc[0]], "ix": [g["ix"].iloc[0]], "r": [out]})

    return both.groupBy(*PROFILE).applyInPandas(tau, "survey_id string, ix int, r double")
