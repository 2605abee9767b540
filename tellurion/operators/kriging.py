"""Nearest neighbours by descent of a quadtree, and ordinary kriging in the neighbourhoods that it finds.

Nodes are searched for in blocks. A block starts at the root square of the survey's points; level by level its squares are replaced by their
quarters, which are rows of a table of counts. A block needs no square that is farther off than a radius within which other squares surely hold
k points, so few squares per block survive a level, in dense clusters and in empty country alike. Squares of at most LEAF points aren't
split any more. Where a block's squares still hold too many points for one task (a cluster under the block), its nodes go on one by one.

Every level is an equi-join on squares and an aggregation by block; a task sees the points of one block's squares, never a survey.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.scratch import written

from .grids import lattice
from .statistics import settled, with_aggregates

#: Nodes to a block's side, points of a square that isn't split, points of a block that one task takes, levels of squares.
SIDE, LEAF, CROWD, LEVELS = 8, 16, 4_000, 22
_SQUARE = ["survey_id", "depth", "cx", "cy"]
_BLOCK = ["survey_id", "by", "bx"]
_OUT = "survey_id string, iy int, ix int, z double, stdev double, farthest double, used int"


def _rooted(points: DataFrame) -> DataFrame:
    """(survey_id, x, y, v, cx, cy at the finest level, and the root square's corner x0, y0 and side): places with mean values."""
    p = points.where("value IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").groupBy("survey_id", "x", "y").agg(F.avg("value").alias("v"))
    p = with_aggregates(p, ["survey_id"], x0=F.min("x"), x1=F.max("x"), y0=F.min("y"), y1=F.max("y"))
    p = p.withColumn("side", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-300)))
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("side") * F.lit(1 << LEVELS)), F.lit((1 << LEVELS) - 1)).cast("int")
    return p.select("survey_id", "x", "y", "v", cell("x").alias("cx"), cell("y").alias("cy"), "x0", "y0", "side")


def _squares(places: DataFrame) -> DataFrame:
    """(survey_id, depth, cx, cy, n, leaf): counts of the squares, no deeper than the first with at most LEAF points."""
    fine = places.groupBy("survey_id", "cx", "cy").agg(F.count("*").alias("n"))
    up = fine.select("survey_id", "n", "cx", "cy", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("depth"))
    shift = LEVELS - F.col("depth")
    up = up.select("survey_id", "depth", F.call_function("shiftright", F.col("cx"), shift).alias("cx"), F.call_function("shiftright", F.col("cy"), shift).alias("cy"), "n")
    sums = up.groupBy(*_SQUARE).agg(F.sum("n").alias("n"))
    parent = sums.where(F.col("n") > LEAF).select("survey_id", (F.col("depth") + 1).alias("depth"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    below = sums.withColumns({"px": F.call_function("shiftright", "cx", F.lit(1)), "py": F.call_function("shiftright", "cy", F.lit(1))}).join(parent, ["survey_id", "depth", "px", "py"], "left_semi")
    roots = sums.where("depth = 0")
    return roots.unionByName(below.select(roots.columns)).withColumn("leaf", (F.col("n") <= LEAF) | (F.col("depth") == LEVELS))


def _distances(near: DataFrame) -> DataFrame:
    """near with least and most: bounds on the distance from any node of the block to any point of the square."""
    wide = F.col("side") / F.pow(F.lit(2.0), F.col("depth"))
    gaps, spans = [], []
    for a in "xy":
        lo = F.col(f"{a}0") + F.col(f"c{a}") * wide
        hi = lo + wide
        gaps.append(F.greatest(lo - F.col(f"{a}b"), F.col(f"{a}a") - hi, F.lit(0.0)))
        spans.append(F.greatest(hi - F.col(f"{a}a"), F.col(f"{a}b") - lo))
    norm = lambda p, q: F.sqrt(p * p + q * q)
    slack = F.col("side") * 1e-9
    return near.withColumns({"least": norm(*gaps) - slack, "most": norm(*spans) + slack})


def _pruned(near: DataFrame, by: list[str], k: int) -> DataFrame:
    """Squares of each block (or node) that may hold one of its k nearest points."""
    ranked = F.array_sort(F.collect_list(F.struct("most", "n")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("r"))

    def reach(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] + x["n"]).alias("n"), F.when((acc["n"] < k) & (acc["n"] + x["n"] >= k), x["most"]).otherwise(acc["r"]).alias("r"))

    bound = near.groupBy(*by).agg(F.aggregate(ranked, start, reach, lambda acc: acc["r"]).alias("bound"))
    return near.join(bound, by).where("least <= bound").drop("bound")


def neighbourhoods(points: DataFrame, info: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(places, near): near has, for each block of nodes (iy0..iy1, ix0..ix1), the squares that hold all of its nodes' k nearest places."""
    places = written(_rooted(points))
    squares = written(_squares(places))
    at = lambda a: F.floor(F.col(f"i{a}") / SIDE).cast("int")
    nodes = lattice(info).withColumns({"by": at("y"), "bx": at("x")})
    blocks = nodes.groupBy(*_BLOCK).agg(*[f(c).alias(n) for c, a, b in (("x", "xa", "xb"), ("y", "ya", "yb"), ("iy", "iy0", "iy1"), ("ix", "ix0", "ix1")) for f, n in ((F.min, a), (F.max, b))])
    root = settled(places.select("survey_id", "x0", "y0", "side").distinct())
    near = blocks.join(root, "survey_id").join(squares.where("depth = 0"), "survey_id")
    quarter = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (0, 1) for j in (0, 1)])
    while True:
        near = written(_pruned(_distances(near), _BLOCK, k))
        if near.where("NOT leaf").isEmpty():
            break
        down = near.where("NOT leaf").drop("n", "leaf").withColumn("q", F.explode(quarter))
        down = down.withColumns({"depth": F.col("depth") + 1, "cx": F.col("cx") * 2 + F.col("q.dx"), "cy": F.col("cy") * 2 + F.col("q.dy")}).drop("q").join(squares, _SQUARE)
        near = near.where("leaf").unionByName(down.select(near.columns))
    crowd = near.groupBy(*_BLOCK).agg(F.sum("n").alias("all")).where(F.col("all") > CROWD).select(*_BLOCK)
    single = near.join(crowd, _BLOCK).drop("least", "most", "xa", "xb", "ya", "yb").join(nodes.select(*_BLOCK, "iy", "ix", "x", "y"), _BLOCK)
    single = single.withColumns({"iy0": F.col("iy"), "iy1": F.col("iy"), "ix0": F.col("ix"), "ix1": F.col("ix"), "xa": F.col("x"), "xb": F.col("x"), "ya": F.col("y"), "yb": F.col("y")})
    single = _pruned(_distances(single.select(*[c for c in near.columns if c not in ("least", "most")])), [*_BLOCK, "iy0", "ix0"], k)
    return places, near.join(crowd, _BLOCK, "left_anti").unionByName(single.select(near.columns))


def krige_near(points: DataFrame, info: DataFrame, gamma, k: int = 32) -> DataFrame:
    """(survey_id, iy, ix, z, stdev, farthest, used): ordinary kriging of every node from its k nearest places.

    gamma: variogram of an array of distances. With fewer than k places all are used. Ties at the k-th distance go to the smaller x, then y.
    """
    places, near = neighbourhoods(points, info, k)
    near = near.select(*_SQUARE, "iy0", "iy1", "ix0", "ix1")
    depths = [r["depth"] for r in near.select("depth").distinct().collect()]
    named = places.select("survey_id", "x", "y", "v", "cx", "cy", F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth")) if depths else places.withColumn("depth", F.lit(0))
    down = LEVELS - F.col("depth")
    named = named.select("survey_id", "depth", F.call_function("shiftright", F.col("cx"), down).alias("cx"), F.call_function("shiftright", F.col("cy"), down).alias("cy"), "x", "y", "v")
    frame = info.select("survey_id", *[F.col(f"{a}_min").alias(f"{a}m") for a in "xy"], *[((F.col(f"{a}_max") - F.col(f"{a}_min")) / F.greatest(F.col(f"n{a}") - 1, F.lit(1))).alias(f"{a}d") for a in "xy"])
    rows = near.join(named, _SQUARE).join(settled(frame), "survey_id")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        f = g.iloc[0]
        g = g.sort_values(["x", "y"])
        x, y, v = (g[c].to_numpy(float) for c in ("x", "y", "v"))
        iy, ix = (a.ravel() for a in np.meshgrid(np.arange(f["iy0"], f["iy1"] + 1), np.arange(f["ix0"], f["ix1"] + 1), indexing="ij"))
        qx, qy = f["xm"] + ix * f["xd"], f["ym"] + iy * f["yd"]
        d = np.hypot(qx[:, None] - x, qy[:, None] - y)
        m = min(k, len(x))
        pick = np.argsort(d, axis=1, kind="stable")[:, :m]
        px, py, pv, pd_ = x[pick], y[pick], v[pick], np.take_along_axis(d, pick, 1)
        a = np.ones((len(qx), m + 1, m + 1))
        a[:, :m, :m], a[:, m, m] = gamma(np.hypot(px[:, :, None] - px[:, None, :], py[:, :, None] - py[:, None, :])), 0
        b = np.ones((len(qx), m + 1))
        b[:, :m] = gamma(pd_)
        try:
            w = np.linalg.solve(a, b[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            w = np.stack([np.linalg.lstsq(p, q, rcond=None)[0] for p, q in zip(a, b, strict=True)])
        return pd.DataFrame({"survey_id": f["survey_id"], "iy": iy.astype(int), "ix": ix.astype(int), "z": (pv * w[:, :m]).sum(1), "stdev": np.sqrt(np.maximum((w * b).sum(1), 0)), "farthest": pd_[:, -1], "used": m})

    return rows.groupBy("survey_id", "iy0", "iy1", "ix0", "ix1").applyInPandas(solve, _OUT)
