"""Join-like operators: distance joins by buckets, as-of brackets, mismatches, borders, georeferencing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .points import KEY
from .statistics import Quantile, group_stats


def overlap(a: DataFrame, b: DataFrame, tolerance: float, keep: list[str] | None = None) -> DataFrame:
    """Pairs of rows of a and b no further apart than tolerance: an equi-join on buckets and an exact test.

    Only a's rows are copied, to the 3 x 3 buckets round them. Columns: id_a, id_b, value_a, value_b, dist.
    """
    size = F.lit(float(tolerance) if tolerance > 0 else 1e-9)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    left = a.select(F.col("pid").alias("id_a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("value").alias("value_a"), F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("bx"), cell("y").alias("cy"))
    left = left.withColumn("by", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    right = b.select(F.col("pid").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("value").alias("value_b"), cell("x").alias("bx"), cell("y").alias("by"))
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    return left.join(right, ["bx", "by"]).withColumn("dist", d).where(F.col("dist") <= F.lit(float(tolerance))).select("id_a", "id_b", "value_a", "value_b", "dist")


def mismatch(pairs: DataFrame, weighted: bool = True, discard: bool = True) -> DataFrame:
    """One row: mean of value_a - value_b, after dropping what is over 2.5 deviations off, and its weight 1 / variance."""
    ok = pairs.withColumn("d", F.col("value_a") - F.col("value_b"))
    if discard:
        s = ok.agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s")).first()  # two numbers, known before the pairs are read again
        ok = ok.where(F.abs(F.col("d") - F.lit(s["m"]).cast("double")) <= F.lit(s["s"]).cast("double") * 2.5)
    got = ok.agg(F.avg("d").alias("mismatch"), F.stddev_pop("d").alias("sd"))
    weight = F.coalesce(F.try_divide(F.lit(1.0), F.col("sd") * F.col("sd")), F.lit(0.0)) if weighted else F.lit(1.0)
    return got.select("mismatch", weight.alias("weight"))


def mismatch_matrix(surveys: list[DataFrame], tolerance: float) -> DataFrame:
    """(i, j, mismatch) for i <> j, antisymmetric."""
    spark = surveys[0].sparkSession
    out = None
    for i in range(len(surveys)):
        for j in range(i + 1, len(surveys)):
            m = mismatch(overlap(surveys[i], surveys[j], tolerance)).select(F.lit(i).alias("i"), F.lit(j).alias("j"), "mismatch")
            both = m.unionAll(m.select(F.lit(j).alias("i"), F.lit(i).alias("j"), (-F.col("mismatch")).alias("mismatch")))
            out = both if out is None else out.unionAll(both)
    return out if out is not None else spark.createDataFrame([], "i int, j int, mismatch double")


def asof_bracket(events: DataFrame, bases: DataFrame, by: list[str], at: str, cols: list[str]) -> DataFrame:
    """For each event the last base before or at it and the first after it: columns ``<c>_before``, ``<c>_after``.

    A union and two running windows per key, so neither side is broadcast or multiplied.
    """
    e = events.withColumn("__base", F.lit(0))
    b = bases.select(*by, F.col(at), *[F.col(c).alias(f"__b_{c}") for c in cols]).withColumn("__base", F.lit(1))
    u = e.unionByName(b, allowMissingColumns=True)
    back = Window.partitionBy(*by).orderBy(F.col(at), F.desc("__base")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col(at), F.desc("__base")).rowsBetween(1, Window.unboundedFollowing)
    for c in cols:
        s = F.when(F.col("__base") == 1, F.struct(F.col(f"__b_{c}").alias("v")))
        u = u.withColumns({f"{c}_before": F.last(s, ignorenulls=True).over(back)["v"], f"{c}_after": F.first(s, ignorenulls=True).over(ahead)["v"]})
    return u.where("__base = 0").select(*events.columns, *[f"{c}_{w}" for c in cols for w in ("before", "after")])


def correct_drift(readings: DataFrame, bases: DataFrame, by: list[str], at: str = "seconds", col: str = "value", diff: bool = True) -> DataFrame:
    """Take the base level, straight between the bases round a reading, off it (or divide by it); readings outside take the nearest base.

    The level is relative to the first base, so values keep their scale.
    """
    first = bases.groupBy(*by).agg(F.min_by(col, at).alias("__ref"))
    b = bases.join(first, by).select(*by, F.col(at), F.col(at).alias("__t"), F.col(col).alias("__v"), "__ref")
    out = asof_bracket(readings, b, by, at, ["__t", "__v", "__ref"])
    t0, t1, v0, v1 = (F.col(f"__{k}_{w}") for k in ("t", "v") for w in ("before", "after"))
    lev = F.coalesce(v0 + (v1 - v0) * F.try_divide(F.col(at) - t0, t1 - t0), v0, v1)
    ref = F.coalesce("__ref_before", "__ref_after")
    new = F.col(col) - (lev - ref) if diff else F.try_divide(F.col(col) * ref, lev)
    return out.withColumn(col, F.coalesce(new, F.col(col))).select(*readings.columns)


def border_pairs(a: DataFrame, b: DataFrame, n: int, reach: float) -> DataFrame:
    """The n closest pairs within reach, each point of a with its nearest of b; ties go to the smaller ids."""
    near = overlap(a, b, reach)
    best = near.groupBy("id_a").agg(F.min(F.struct("dist", "id_b", "value_a", "value_b")).alias("s"))
    return best.select("id_a", "s.*").orderBy("dist", "id_a", "id_b").limit(n)


def linear_match(pairs: DataFrame) -> DataFrame:
    """One row (a, b): value_a is about a + b * value_b, with b the deviations' ratio."""
    b = F.coalesce(F.try_divide(F.stddev_pop("value_a"), F.stddev_pop("value_b")), F.lit(1.0))
    return pairs.agg(b.alias("b"), F.avg("value_a").alias("ma"), F.avg("value_b").alias("mb")).select((F.col("ma") - F.col("b") * F.col("mb")).alias("a"), "b")


def join_borders(surveys: dict[int, DataFrame], reach: float) -> dict[int, DataFrame]:
    """Bring surveys to the first one's scale, going from each matched survey to those that border on it (breadth first).

    The loop is over surveys, a short list; points stay distributed. A border needs 3 pairs at least.
    """
    names = sorted(surveys)
    done, queue = {names[0]: surveys[names[0]]}, [names[0]]
    while queue:
        k = queue.pop(0)
        for other in (n for n in names if n not in done):
            a, b = done[k], surveys[other]
            count = 30 + int(0.2 * np.sqrt(min(a.count(), b.count())))
            pairs = border_pairs(a, b, count, reach)
            fit = pairs.agg(F.count("*").alias("n"), F.stddev_pop("value_a").alias("sa"), F.stddev_pop("value_b").alias("sb"), F.avg("value_a").alias("ma"), F.avg("value_b").alias("mb")).first()
            if fit["n"] >= 3:
                slope = fit["sa"] / fit["sb"] if fit["sb"] else 1.0
                done[other] = b.withColumn("value", F.bround(F.lit(fit["ma"] - slope * fit["mb"]) + F.lit(slope) * F.col("value"), 2))
                queue.append(other)
    return {n: done.get(n, surveys[n]) for n in names}


def match_level(frames: list[DataFrame], stat: str = "median") -> list[DataFrame]:
    """Shift each survey so that its median or mean is the first one's: two numbers that the driver knows before the rows are read again."""
    own = [group_stats(d, [], s=Quantile("value", 0.5) if stat == "median" else F.avg("value")).first() for d in frames]
    level = [F.lit(None if r is None else r["s"]).cast("double") for r in own]
    return [frames[0], *[d.withColumn("value", F.col("value") - s + level[0]) for d, s in zip(frames[1:], level[1:], strict=True)]]


def merge_grids(grids: list[DataFrame]) -> DataFrame:
    """Cell means of grids on one common lattice; cells without values are NULL."""
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out.groupBy("iy", "ix").agg(F.avg("z").alias("z"))


def triangulate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Delaunay triangles (k, 3) of a few points by insertion (Bowyer and Watson); repeated points are left out."""
    pts = np.stack((x, y), 1).astype(float)
    _, first = np.unique(np.round(pts, 12), axis=0, return_index=True)
    ids = np.sort(first)
    if len(ids) < 3:
        return np.zeros((0, 3), int)
    lo, hi = pts[ids].min(0), pts[ids].max(0)
    mid, span = (lo + hi) / 2, max(float((hi - lo).max()), 1e-9)
    far = np.array([mid + span * np.array(c) for c in ((-1500, -1000), (1500, -1000), (0, 2000))])  # far off, so that slim triangles at the rim survive
    n = len(pts)
    p = np.vstack((pts, far))
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        d = 2 * ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
        d = np.where(np.abs(d) < 1e-300, 1e-300, d)
        b2, c2 = ((b - a) ** 2).sum(1), ((c - a) ** 2).sum(1)
        u = np.stack((((c - a)[:, 1] * b2 - (b - a)[:, 1] * c2) / d, ((b - a)[:, 0] * c2 - (c - a)[:, 0] * b2) / d), 1)
        return a + u, (u**2).sum(1)

    centre, r2 = circles(tri)
    for i in ids.tolist():
        bad = ((centre - p[i]) ** 2).sum(1) < r2 * (1 + 1e-12)
        e = np.concatenate((tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]))
        _, inv, count = np.unique(np.sort(e, 1), axis=0, return_inverse=True, return_counts=True)
        rim = e[count[inv.ravel()] == 1]
        fresh = np.column_stack((rim, np.full(len(rim), i)))
        c2, q2 = circles(fresh)
        tri, centre, r2 = np.vstack((tri[~bad], fresh)), np.vstack((centre[~bad], c2)), np.concatenate((r2[~bad], q2))
    tri = tri[(tri < n).all(1)]
    a, b, c = pts[tri[:, 0]], pts[tri[:, 1]], pts[tri[:, 2]]
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    return tri[area > 1e-12 * span * span]


def georeference(points: DataFrame, controls: list[tuple[float, float, float, float]]) -> DataFrame:
    """Adds east and north by the control points' triangles (x, y, east, north); outside them NULL.

    Needs four control points at least. Triangles are a handful per survey, so they are one constant array.
    """
    c = np.array(controls, float)
    if len(c) < 4 or np.isnan(c).any():
        raise ValueError("four complete control points are needed")
    rows = []
    for t in triangulate(c[:, 0], c[:, 1]):
        x, y = c[t, 0], c[t, 1]
        m = np.linalg.inv(np.array([[x[0], x[1], x[2]], [y[0], y[1], y[2]], [1, 1, 1]]))
        rows.append((m, m.T @ np.zeros(3), c[t, 2], c[t, 3]))

    def bary(m: np.ndarray, k: int) -> Column:
        return F.lit(float(m[k, 0])) * F.col("x") + F.lit(float(m[k, 1])) * F.col("y") + F.lit(float(m[k, 2]))

    east = north = F.lit(None).cast("double")
    for m, _, e, n in reversed(rows):
        w = [bary(m, k) for k in range(3)]
        inside = (w[0] >= -1e-9) & (w[1] >= -1e-9) & (w[2] >= -1e-9)
        east = F.when(inside, sum((w[k] * F.lit(float(e[k])) for k in range(3)), F.lit(0.0))).otherwise(east)
        north = F.when(inside, sum((w[k] * F.lit(float(n[k])) for k in range(3)), F.lit(0.0))).otherwise(north)
    return points.withColumns({"east": east, "north": north})


def nearest_value(df: DataFrame, target: float, col: str = "value") -> DataFrame:
    """Per survey the row's value closest to target, the smaller pid among equals."""
    return df.groupBy(*KEY).agg(F.min(F.struct(F.abs(F.col(col) - F.lit(float(target))).alias("d"), "pid", F.col(col).alias("v"))).alias("s")).select(*KEY, F.col("s.pid").alias("pid"), F.col("s.v").alias("value"))


def border_quality(pairs: DataFrame, a: DataFrame) -> DataFrame:
    """Whether pairs make a border: consecutive spacing against the survey's diagonal, and extent."""
    pos = pairs.join(a.select(F.col("pid").alias("id_a"), "x", "y"), "id_a")
    w = Window.orderBy("dist", "id_a")  # at most a few dozen pairs
    step2 = F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)
    got = pos.withColumn("d2", step2).agg(F.avg("d2").alias("mean_d2"), (F.pow(F.max("x") - F.min("x"), 2) + F.pow(F.max("y") - F.min("y"), 2)).alias("extent2"))
    box = a.agg((F.pow(F.max("x") - F.min("x"), 2) + F.pow(F.max("y") - F.min("y"), 2)).alias("diag2"))
    return got.crossJoin(box).select("mean_d2", "extent2", "diag2", ((F.sqrt("mean_d2") <= 0.1 * F.sqrt("diag2")) & (F.sqrt("extent2") >= 0.2 * F.sqrt("diag2"))).alias("accepted"))


