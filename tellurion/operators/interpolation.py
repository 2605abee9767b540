"""Gridding and interpolation beyond cell means, and variograms."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grids import CELL, lattice, tile_index, tile_mask, tile_mask_round
from .kriging import krige_near
from .statistics import group_stats, matched, settled
from .triangulation import cubic, linear

_NODES = "survey_id string, iy int, ix int, z double"


def nearest(points: DataFrame, info: DataFrame, reach: float) -> DataFrame:
    """Each node's nearest value within reach, by buckets; ties go to the smaller pid."""
    r = F.lit(float(reach))
    cell = lambda c: F.floor(F.col(c) / r).cast("long")
    nodes = lattice(info).withColumns({"bx": cell("x"), "by": cell("y")})
    p = points.where("value is not null").select("survey_id", "pid", F.col("x").alias("px"), F.col("y").alias("py"), "value", F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("bx"), cell("y").alias("cy"))
    p = p.withColumn("by", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1))).drop("cy")
    d = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    got = nodes.join(p, ["survey_id", "bx", "by"]).withColumn("d", d).where(F.col("d") <= r * r)
    best = got.groupBy(*CELL).agg(F.min(F.struct("d", "pid", "value")).alias("s")).select(*CELL, F.col("s.value").alias("z"))
    return lattice(info).select(*CELL).join(best, CELL, "left")


def masked(points: DataFrame, info: DataFrame, values: DataFrame, n: int = 100, radius: int = 2, power: float = 0.0, all_round: bool = False, keep: bool = True) -> DataFrame:
    """values (cells of any interpolation or kriging) with NULL in nodes whose tile has too few points near.

    The tiles are those of tile_mask, or of tile_mask_round with ``all_round``; with ``keep``, tiles that hold a point stay too.
    """
    mask = tile_mask_round(points, n, radius) if all_round else tile_mask(points, n, radius, power)
    box = points.groupBy("survey_id").agg(*[f(F.col(a)).alias(f"__{a}{k}") for a in "xy" for k, f in ((0, F.min), (1, F.max))])
    size = lambda a: F.when(F.col(f"__{a}1") > F.col(f"__{a}0"), (F.col(f"__{a}1") - F.col(f"__{a}0")) / n).otherwise(1.0)
    tile = lambda a: tile_index(a, F.col(f"__{a}0"), size(a), n).alias(f"t{a}")
    mask = mask.select("survey_id", F.col("iy").alias("ty"), F.col("ix").alias("tx"))
    if keep:
        mask = mask.unionByName(points.join(box, "survey_id").select("survey_id", tile("y"), tile("x"))).distinct()
    nodes = lattice(info).join(box, "survey_id").select(*CELL, tile("y"), tile("x"))
    kept = nodes.join(mask, ["survey_id", "ty", "tx"], "left_semi").select(*CELL, F.lit(True).alias("__in"))
    return values.join(kept, CELL, "left").withColumn("z", F.when(F.col("__in"), F.col("z"))).select(*values.columns)


RBF = ("linear", "thin_plate_spline", "cubic", "quintic")


def radial(points: DataFrame, info: DataFrame, kind: str = "linear", limit: int = 3000) -> DataFrame:
    """Radial basis interpolation with a polynomial tail: one dense solve per survey, refused beyond ``limit`` points."""
    if kind not in RBF:
        raise ValueError(f"kind must be one of {RBF}")
    degree = {"linear": 0, "thin_plate_spline": 1, "cubic": 1, "quintic": 2}[kind]

    def basis(r: np.ndarray) -> np.ndarray:
        if kind == "linear":
            return -r
        if kind == "thin_plate_spline":
            return np.where(r > 0, r * r * np.log(np.where(r > 0, r, 1)), 0)
        return r**3 if kind == "cubic" else -(r**5)

    def tail(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([x**i * y**j for i in range(degree + 1) for j in range(degree + 1 - i)], 1)

    def work(g: pd.DataFrame) -> pd.DataFrame:
        node = g["iy"].notna()
        a, b = g[~node].groupby(["x", "y"], as_index=False)["v"].mean(), g[node]
        if len(a) > limit:
            raise ValueError(f"{len(a)} points; a dense solve takes {limit} at most")
        x, y = a["x"].to_numpy(float), a["y"].to_numpy(float)
        sx, sy = np.ptp(x) or 1.0, np.ptp(y) or 1.0
        s, ox, oy = max(sx, sy), x.mean(), y.mean()
        x, y, qx, qy = (x - ox) / s, (y - oy) / s, (b["x"].to_numpy(float) - ox) / s, (b["y"].to_numpy(float) - oy) / s
        p = tail(x, y)
        m = np.block([[basis(np.hypot(x[:, None] - x, y[:, None] - y)), p], [p.T, np.zeros((p.shape[1],) * 2)]])
        w = np.linalg.lstsq(m, np.concatenate((a["v"].to_numpy(float), np.zeros(p.shape[1]))), rcond=None)[0]
        z = basis(np.hypot(qx[:, None] - x, qy[:, None] - y)) @ w[: len(x)] + tail(qx, qy) @ w[len(x) :]
        return pd.DataFrame({"survey_id": b["survey_id"], "iy": b["iy"].astype(int), "ix": b["ix"].astype(int), "z": z})

    return _both(points, info).groupBy("survey_id").applyInPandas(work, _NODES)


def _both(points: DataFrame, info: DataFrame) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    p = points.where("value is not null").select("survey_id", "x", "y", F.col("value").alias("v"), none("int").alias("iy"), none("int").alias("ix"))
    return p.unionByName(lattice(info).select("survey_id", "x", "y", none("double").alias("v"), "iy", "ix"))


def sample(points: DataFrame, grid: DataFrame, info: DataFrame) -> DataFrame:
    """points with ``sampled``: bilinear values of the grid; NULL outside and where a corner is missing.

    The four corners of each mesh meet first, in one row; a point, whatever its pid, takes that of its mesh. So points are neither multiplied nor sent by survey.
    """
    corners = [(a, b) for a in (0, 1) for b in (0, 1)]
    of = grid.where("z IS NOT NULL").withColumn("c", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in corners])))
    z = {(a, b): F.max(F.when((F.col("c.dy") == a) & (F.col("c.dx") == b), F.col("z"))).alias(f"__z{a}{b}") for a, b in corners}
    meshes = of.groupBy("survey_id", (F.col("iy") - F.col("c.dy")).cast("int").alias("__ky"), (F.col("ix") - F.col("c.dx")).cast("int").alias("__kx")).agg(*z.values())
    meshes = meshes.where(" AND ".join(f"__z{a}{b} IS NOT NULL" for a, b in corners))
    ends = ("nx", "ny", "x_min", "x_max", "y_min", "y_max")
    p = points.join(settled(info.select("survey_id", *[F.col(c).alias(f"__{c}") for c in ends])), "survey_id", "left")
    inside = F.expr("x between __x_min and __x_max and y between __y_min and __y_max")
    placed = {a: _placed(F.col(a), f"__{a}_min", f"__{a}_max", f"__n{a}") for a in ("x", "y")}
    p = p.withColumns({f"__{v}{a}": F.when(inside, c) for a in placed for v, c in zip("kf", placed[a], strict=True)}).join(settled(meshes), ["survey_id", "__ky", "__kx"], "left")
    w = {(a, b): (F.col("__fx") if b else 1 - F.col("__fx")) * (F.col("__fy") if a else 1 - F.col("__fy")) for a, b in corners}
    sampled = reduce(lambda s, t: s + t, [w[a, b] * F.col(f"__z{a}{b}") for a, b in corners])
    return p.select("survey_id", "pid", *[c for c in points.columns if c not in ("survey_id", "pid")], sampled.alias("sampled"))


def _cubic_nodes(base: Column, f: Column, n: Column) -> Column:
    """(at, w) of the nodes of a line that a place f beyond node ``base`` is made of: cubic convolution, third order up to the rims.

    Beyond a rim, nodes follow the parabola through the last three; lines of two nodes are straight, of one constant. Nodes of no weight are left out.
    """
    g = 1 - f
    w = [-0.5 * f * g * g, 1 - 2.5 * f * f + 1.5 * f * f * f, 1 - 2.5 * g * g + 1.5 * g * g * g, -0.5 * g * f * f]
    node = lambda k, weight: F.struct((base + F.lit(k)).cast("int").alias("at"), weight.alias("w"))
    inner = F.array(*[node(k - 1, w[k]) for k in range(4)])
    low = F.array(node(0, w[1] + 3 * w[0]), node(1, w[2] - 3 * w[0]), node(2, w[3] + w[0]))
    high = F.array(node(-1, w[0] + w[3]), node(0, w[1] - 3 * w[3]), node(1, w[2] + 3 * w[3]))
    nodes = F.when(n < 2, F.array(node(0, F.lit(1.0)))).when(n == 2, F.array(node(0, g), node(1, f))).when(base == 0, low).when(base == n - 2, high).otherwise(inner)
    return F.filter(nodes, lambda v: v["w"] != 0)


def _placed(value: Column, low: str, high: str, n: str) -> tuple[Column, Column]:
    """Node below a place on a line of n nodes, and how far beyond it (0 to 1)."""
    at = F.when((F.col(n) > 1) & (F.col(high) > F.col(low)), (value - F.col(low)) * (F.col(n) - 1) / (F.col(high) - F.col(low))).otherwise(0.0)
    base = F.greatest(F.least(F.floor(at), F.col(n) - 2), F.lit(0)).cast("int")
    return base, at - base


def sample_cubic(points: DataFrame, grid: DataFrame, info: DataFrame) -> DataFrame:
    """points (pid unique in a survey) with ``sampled``: values of a smooth surface (C1) through the grid's nodes; NULL outside and where a node it is made of has no value.

    Parabolas are met exactly, up to the rims.
    """
    p = points.select("survey_id", "pid", "x", "y").join(settled(info), "survey_id").where("x between x_min and x_max and y between y_min and y_max")
    for a in ("x", "y"):
        p = p.withColumn(f"w{a}", _cubic_nodes(*_placed(F.col(a), f"{a}_min", f"{a}_max", f"n{a}"), F.col(f"n{a}")))
    p = p.select("survey_id", "pid", (F.size("wx") * F.size("wy")).alias("__n"), "wx", F.explode("wy").alias("u")).withColumn("v", F.explode("wx"))
    p = p.select("survey_id", "pid", "__n", F.col("u.at").alias("iy"), F.col("v.at").alias("ix"), (F.col("u.w") * F.col("v.w")).alias("w"))
    got = p.join(settled(grid.where("z IS NOT NULL").select(*CELL, "z")), CELL).groupBy("survey_id", "pid").agg(F.when(F.count("*") == F.first("__n"), F.sum(F.col("w") * F.col("z"))).alias("sampled"))
    return points.join(got, ["survey_id", "pid"], "left")


def regrid(grid: DataFrame, info: DataFrame, fresh: DataFrame) -> DataFrame:
    """(survey_id, iy, ix, z): the same surface on the lattice of ``fresh`` (an info with other node counts or extents), one axis after the other.

    Nodes outside the old extents, or made of a node without a value, are left out.
    """
    new = fresh.select("survey_id", *[F.col(c).alias(f"new_{c}") for c in ("nx", "ny", "x_min", "x_max", "y_min", "y_max")])
    both = info.join(new, "survey_id")
    for a in ("x", "y"):
        other = "iy" if a == "x" else "ix"
        line = both.withColumn("to", F.explode(F.sequence(F.lit(0), F.col(f"new_n{a}") - 1)))
        place = F.col(f"new_{a}_min") + F.when(F.col(f"new_n{a}") > 1, F.col("to") * (F.col(f"new_{a}_max") - F.col(f"new_{a}_min")) / (F.col(f"new_n{a}") - 1)).otherwise(0.0)
        line = line.withColumn("place", place).where(F.col("place").between(F.col(f"{a}_min"), F.col(f"{a}_max")))
        nodes = _cubic_nodes(*_placed(F.col("place"), f"{a}_min", f"{a}_max", f"n{a}"), F.col(f"n{a}"))
        line = settled(line.select("survey_id", "to", nodes.alias("nodes")).select("survey_id", "to", F.size("nodes").alias("n"), F.inline("nodes")).withColumnRenamed("at", f"i{a}"))
        sums = grid.where("z IS NOT NULL").join(line, ["survey_id", f"i{a}"]).groupBy("survey_id", other, "to").agg(F.sum(F.col("w") * F.col("z")).alias("z"), (F.count("*") == F.first("n")).alias("whole"))
        grid = sums.where("whole").select("survey_id", other, F.col("to").alias(f"i{a}"), "z")
    return grid.select(*CELL, "z")


def variogram(points: DataFrame, lag: float, lags: int, direction: float | None = None, tolerance: float = 22.5) -> DataFrame:
    """(survey_id, lag, n, distance, gamma): half mean squared differences of pairs by distance, optionally in one direction.

    Pairs come from an equi-join on buckets as wide as the longest lag.
    """
    reach = lag * lags
    cell = lambda c: F.floor(F.col(c) / F.lit(float(reach))).cast("long")
    p = points.where("value is not null").select("survey_id", "pid", "x", "y", "value")
    a = p.withColumn("bx", F.explode(F.sequence(cell("x") - 1, cell("x") + 1))).withColumn("by", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
    b = p.select("survey_id", F.col("pid").alias("q"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("value").alias("w"), cell("x").alias("bx"), cell("y").alias("by"))
    dx, dy = F.col("u") - F.col("x"), F.col("v") - F.col("y")
    pairs = a.join(b, ["survey_id", "bx", "by"]).where("pid < q").withColumn("d", F.sqrt(dx * dx + dy * dy)).where((F.col("d") > 0) & (F.col("d") < F.lit(float(reach))))
    if direction is not None:
        t = F.lit(float(np.radians(direction)))
        off = F.abs(F.sin(F.atan2(dy, dx) - t))
        pairs = pairs.where(off <= F.lit(float(np.sin(np.radians(tolerance)))))
    k = F.floor(F.col("d") / F.lit(float(lag))).cast("int")
    return pairs.groupBy("survey_id", k.alias("lag")).agg(F.count("*").alias("n"), F.avg("d").alias("distance"), (F.avg(F.pow(F.col("value") - F.col("w"), 2)) / 2).alias("gamma"))


MODELS = {
    "linear": lambda h, r: h / r,
    "spherical": lambda h, r: np.where(h < r, 1.5 * h / r - 0.5 * (h / r) ** 3, 1.0),
    "exponential": lambda h, r: 1 - np.exp(-3 * h / r),
    "gaussian": lambda h, r: 1 - np.exp(-3 * (h / r) ** 2),
}


def fit_variogram(table: pd.DataFrame, kind: str = "spherical") -> dict[str, float]:
    """Nugget, sill and range by weighted least squares: linear in nugget and sill, the range from a grid of candidates."""
    h, g, n = (table[c].to_numpy(float) for c in ("distance", "gamma", "n"))
    best = None
    for r in np.linspace(h.max() / 20, 2 * h.max(), 80):
        f = MODELS[kind](h, r)
        w = np.sqrt(n)
        c = np.linalg.lstsq(np.stack((w, w * f), 1), w * g, rcond=None)[0]
        if c[0] < 0:
            c = np.array([0.0, float((n * f * g).sum() / max((n * f * f).sum(), 1e-300))])
        c = np.maximum(c, 0)
        e = float((n * (c[0] + c[1] * f - g) ** 2).sum())
        if best is None or e < best[0]:
            best = (e, {"kind": kind, "nugget": float(c[0]), "sill": float(c[1]), "range": float(r)})
    return best[1]


def krige(points: DataFrame, info: DataFrame, model: dict, limit: int = 2000, near: int = 64) -> DataFrame:
    """(survey_id, iy, ix, z, stdev): ordinary kriging; surveys of up to ``limit`` places with all of them, larger ones with the ``near`` nearest to each node."""

    def gamma(h: np.ndarray) -> np.ndarray:
        return np.where(h > 0, model["nugget"] + model["sill"] * MODELS[model["kind"]](h, model["range"]), 0.0)

    def work(g: pd.DataFrame) -> pd.DataFrame:
        node = g["iy"].notna()
        a, b = g[~node].groupby(["x", "y"], as_index=False)["v"].mean(), g[node]
        x, y, v = (a[c].to_numpy(float) for c in ("x", "y", "v"))
        n = len(x)
        if not n:
            return pd.DataFrame({"survey_id": b["survey_id"], "iy": b["iy"].astype(int), "ix": b["ix"].astype(int), "z": np.nan, "stdev": np.nan})
        m = np.ones((n + 1, n + 1))
        m[:n, :n], m[n, n] = gamma(np.hypot(x[:, None] - x, y[:, None] - y)), 0
        r = np.ones((n + 1, len(b)))
        r[:n] = gamma(np.hypot(x[:, None] - b["x"].to_numpy(float), y[:, None] - b["y"].to_numpy(float)))
        w = np.linalg.lstsq(m, r, rcond=None)[0]
        return pd.DataFrame({"survey_id": b["survey_id"], "iy": b["iy"].astype(int), "ix": b["ix"].astype(int), "z": v @ w[:n], "stdev": np.sqrt(np.maximum((w * r).sum(0), 0))})

    sizes = group_stats(points.where("value IS NOT NULL").select("survey_id", "x", "y").distinct(), ["survey_id"], n=F.count("*"))
    large = sizes.where(F.col("n") > limit).select("survey_id")
    few = lambda d: matched(d, large, ["survey_id"], "left_anti")
    whole = _both(few(points), few(info)).groupBy("survey_id").applyInPandas(work, _NODES + ", stdev double")
    if large.isEmpty():
        return whole
    many = lambda d: matched(d, large, ["survey_id"], "left_semi")
    return whole.unionByName(krige_near(many(points), many(info), gamma, near).select("survey_id", "iy", "ix", "z", "stdev"))


__all__ = ["MODELS", "RBF", "cubic", "fit_variogram", "krige", "krige_near", "linear", "masked", "nearest", "radial", "regrid", "sample", "sample_cubic", "variogram"]
