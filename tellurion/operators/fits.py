"""Curves through point clouds, group by group: least squares, Huber's robust fit, and the normal curve of a histogram.

A fit's rows are never gathered: each step is one aggregation of the products of its terms, the rest is one small solve per group. Robust weights
come from the last coefficients, which go back to the rows as one row per group, and from the exact median of the residuals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tellurion.scratch import written

from .points import KEY, histogram
from .statistics import Quantile, few, group_stats, local, matched

#: Residuals beyond TUNING scales weigh less; the scale is the median size of residuals, times SCALE for normal errors.
TUNING, SCALE = 1.35, 1.4826


def terms_of(x: str, kind: str) -> list[Column]:
    """Terms of a relation in x: 'linear', 'poly_3' (powers up to the third) or 'inverse_3' (x, its square root and its cube root)."""
    v = F.col(x).cast("double")
    if kind == "linear":
        return [F.lit(1.0), v]
    if kind == "poly_3":
        return [F.lit(1.0), v, v * v, v * v * v]
    if kind == "inverse_3":
        return [F.lit(1.0), v, F.sqrt(v), F.cbrt(v)]
    raise ValueError("kind must be linear, poly_3 or inverse_3")


def _solved(df: DataFrame, by: Sequence[str], terms: Sequence[Column], y: Column, weight: Column | None = None) -> DataFrame:
    """(by, n, coefficients) of the least squares of y on the terms; NULL coefficients where rows don't settle them."""
    k = len(terms)
    w = F.lit(1.0) if weight is None else weight
    products = [F.sum(w * terms[i] * terms[j]) for i in range(k) for j in range(i + 1)] + [F.sum(w * t * y) for t in terms]
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.array(*products).alias("__s"))
    at = np.tril_indices(k)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for s in part["__s"]:
                s = np.asarray(s, float)
                m = np.zeros((k, k))
                m[at] = s[: len(at[0])]
                m = np.tril(m) + np.tril(m, -1).T
                size = np.sqrt(np.diag(m))
                usable = np.isfinite(s).all() and (size > 0).all()
                even = m / np.outer(size, size) if usable else m
                full = usable and np.linalg.matrix_rank(even, tol=1e-13, hermitian=True) == k
                out.append((np.linalg.solve(even, s[len(at[0]) :] / size) / size).tolist() if full else None)
            yield part.drop(columns="__s").assign(coefficients=out)

    schema = df.select(*by).schema.add("n", "long").add("coefficients", ArrayType(DoubleType()))
    return sums.mapInPandas(solve, schema)


def _kept(coefficients: DataFrame) -> tuple[DataFrame, list | None]:
    """The coefficients computed once: a broadcast local table with its rows, or, of very many groups, a written one."""
    rows = few(coefficients)
    if rows is None:
        return written(coefficients), None
    return F.broadcast(local(coefficients, rows)), rows


def relation_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = (), kind: str = "linear", robust: bool | None = None, rounds: int = 50, settle: float = 1e-9) -> DataFrame:
    """(by, n, coefficients lowest first) of y's relation to x; robust by default for 'poly_3' only.

    Rows with a null, NaN or infinite x or y are left out, for 'inverse_3' those with x below 0 too. A group whose rows don't settle the
    coefficients (fewer distinct x than terms) has NULL; repeated rows count as often as they occur. Robust fits go on until no
    coefficient moves by more than ``settle`` of its size, ``rounds`` steps at most.
    """
    everything = not by
    by = list(by) or ["__all"]
    df = df.withColumn("__all", F.lit(0)) if everything else df
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).where(finite("__x") & finite("__y"))
    rows = rows.where("__x >= 0") if kind == "inverse_3" else rows
    terms, target = terms_of("__x", kind), F.col("__y")
    found, known = _kept(_solved(rows, by, terms, target))
    for _ in range(rounds if (kind == "poly_3" if robust is None else robust) else 0):
        left = matched(rows, found.where("coefficients IS NOT NULL").drop("n"), by)
        off = F.abs(target - sum((F.col("coefficients")[i] * t for i, t in enumerate(terms)), F.lit(0.0)))
        left = left.withColumn("__r", off)
        left = matched(left, group_stats(left, by, __m=Quantile("__r", 0.5)), by)
        scale = F.col("__m") * SCALE
        weight = F.when((F.col("__r") > scale * TUNING) & (scale > 1e-12), scale * TUNING / F.col("__r")).otherwise(1.0)
        fresh = _solved(left.withColumn("__w", weight), by, terms, target, F.col("__w"))
        last, found, known = known, *_kept(fresh.unionByName(found.where("coefficients IS NULL")))
        if last is not None and known is not None and _settled(last, known, by, settle):
            break
    found = found.select(*by, "n", "coefficients")
    return found.drop("__all") if everything else found


def _settled(last: list[dict], now: list[dict], by: Sequence[str], settle: float) -> bool:
    """Whether no group's coefficients moved."""
    before = {tuple(r[b] for b in by): r["coefficients"] for r in last}
    moved = [(before[tuple(r[b] for b in by)], r["coefficients"]) for r in now]
    return all(a is None or b is None or np.allclose(a, b, rtol=settle, atol=1e-300) for a, b in moved)


def gaussian_curve(df: DataFrame, bins: int = 50, col: str = "value", by: Sequence[str] | None = None, steps: int = 200) -> DataFrame:
    """(by, a, x0, sigma, squares): the normal curve a exp(-(x - x0)^2 / (2 sigma^2)) nearest to the counts of equally wide bins at their middles.

    Damped Gauss-Newton steps from the moments, on the counts only (``bins`` numbers a group, empty bins among them). Groups of one value, or of none, have NULL.
    """
    by = list(by or KEY)
    known = df.where(F.col(col).isNotNull())
    moments = group_stats(known, by, __lo=F.min(col).cast("double"), __hi=F.max(col).cast("double"), __mean=F.avg(col), __sd=F.stddev_pop(col))
    counts = histogram(known, bins, col=col, by=by).groupBy(*by).agg(F.collect_list(F.struct("bin", "n")).alias("__bins"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [_nearest_curve(g, bins, steps) for g in part[["__lo", "__hi", "__mean", "__sd", "__bins"]].itertuples(index=False, name=None)]
            yield part[by].assign(**{c: [g[i] for g in got] for i, c in enumerate(("a", "x0", "sigma", "squares"))})

    schema = df.select(*by).schema
    for c in ("a", "x0", "sigma", "squares"):
        schema = schema.add(c, "double")
    return matched(counts, moments, by).mapInPandas(solve, schema)


def _nearest_curve(group: tuple, bins: int, steps: int) -> tuple[float | None, ...]:
    low, high, mean, sd, listed = group
    if not high > low:
        return None, None, None, None
    count = np.zeros(bins)
    for entry in listed:
        count[entry["bin"]] = entry["n"]
    at = low + (np.arange(bins) + 0.5) * (high - low) / bins
    p, damp = np.array([count.sum() * (high - low) / bins / (sd * np.sqrt(2 * np.pi)), mean, sd]), 1e-3

    def curve(p: np.ndarray) -> np.ndarray:
        return p[0] * np.exp(-((at - p[1]) ** 2) / (2 * p[2] ** 2))

    off = count - curve(p)
    for _ in range(steps):
        shape = curve(p)
        j = np.column_stack((shape / p[0], shape * (at - p[1]) / p[2] ** 2, shape * (at - p[1]) ** 2 / p[2] ** 3))
        m = j.T @ j
        step = np.linalg.lstsq(m + damp * np.diag(np.diag(m)), j.T @ off, rcond=None)[0]
        new = p + step
        better = count - curve(new) if new[0] > 0 and new[2] > 0 else None
        if better is not None and better @ better <= off @ off:
            done = np.all(np.abs(step) <= 1e-12 * np.abs(p).max())
            p, off, damp = new, better, max(damp / 10, 1e-12)
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    return float(p[0]), float(p[1]), float(p[2]), float(off @ off)
