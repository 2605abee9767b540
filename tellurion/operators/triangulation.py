"""Delaunay triangulation by parallel divide and conquer, and interpolation on its triangles.

Every round deals the points that are still open to square cells of a bounded number of points, and each cell is triangulated by itself.
A triangle whose circumcircle lies inside its cell can't be changed by points elsewhere, so it is settled. A point whose
settled triangles surround it is done; the others go on, to cells twice as wide or more, where the seams of the last round lie inside. So open points dwindle
to the seams of ever larger cells and the rim, and no cell ever sees all points of a survey.

A triangle of open points only may cover ground that is settled (its circle holds points that are done). It then lies wholly on such ground,
for two triangles of one Delaunay triangulation never cross: its direction at any of its corners falls inside a settled triangle there, and it is dropped by
an equi-join on that corner.

Points on a lattice have many equal circles. A shift of each point by a hash of its place, too small to matter (JITTER of the mean spacing), gives all
cells the same choice; values are interpolated at the true places. Repeated places count once, with the mean of their values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.scratch import written

from .grids import CELL, lattice
from .joins import triangulate
from .statistics import settled, with_aggregates

#: Points of a cell, depth of the finest cells (2^DEPTH to a side), shift of points, and rounding allowed in angles and places.
MOST, DEPTH, JITTER, SLACK = 800, 20, 1e-6, 1e-7
_KEY = ["survey_id"]
_TRI = "survey_id string, a bigint, b bigint, c bigint"


def _dedupe(points: DataFrame) -> DataFrame:
    """(survey_id, id, x, y, v, u, w): places with their mean value, and shifted places in units of the survey's box, 0 to 1."""
    p = points.where("value IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").groupBy("survey_id", "x", "y").agg(F.avg("value").alias("v"))
    p = written(p.withColumn("id", F.monotonically_increasing_id()))
    p = with_aggregates(p, _KEY, __n=F.count("*"), __x0=F.min("x"), __x1=F.max("x"), __y0=F.min("y"), __y1=F.max("y"))
    side = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"), F.lit(1e-300))
    shift = lambda k: (F.pmod(F.xxhash64("x", "y", F.lit(k)), F.lit(1 << 20)) / (1 << 20) - 0.5) * JITTER / F.sqrt(F.col("__n").cast("double"))
    return p.select("survey_id", "id", "x", "y", "v", ((F.col("x") - F.col("__x0")) / side + shift(1)).alias("u"), ((F.col("y") - F.col("__y0")) / side + shift(2)).alias("w"))


def _cells(open_points: DataFrame, most: int) -> DataFrame:
    """open_points with depth, cx, cy: the widest square of the dyadic hierarchy round each that holds at most ``most`` of them (at DEPTH, whatever it holds)."""
    at = lambda c: F.least(F.greatest(F.floor(F.col(c) * F.lit(1 << DEPTH)), F.lit(0)), F.lit((1 << DEPTH) - 1)).cast("int")
    p = open_points.withColumns({"__u": at("u"), "__w": at("w")})
    fine = p.groupBy("survey_id", "__u", "__w").agg(F.count("*").alias("n"))
    up = fine.select("survey_id", "__u", "__w", "n", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth"))
    up = up.withColumns({"cx": F.call_function("shiftright", F.col("__u"), DEPTH - F.col("depth")), "cy": F.call_function("shiftright", F.col("__w"), DEPTH - F.col("depth"))})
    held = up.groupBy("survey_id", "depth", "cx", "cy").agg(F.sum("n").alias("held")).where((F.col("held") <= most) | (F.col("depth") == DEPTH))
    fits = up.join(held, ["survey_id", "depth", "cx", "cy"]).groupBy("survey_id", "__u", "__w").agg(F.min(F.struct("depth", "cx", "cy")).alias("cell"))
    return p.join(fits, ["survey_id", "__u", "__w"]).select(*open_points.columns, "cell.depth", "cell.cx", "cell.cy")


def _circles(u: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ax, ay = u[t[:, 0]], w[t[:, 0]]
    bx, by, cx, cy = u[t[:, 1]] - ax, w[t[:, 1]] - ay, u[t[:, 2]] - ax, w[t[:, 2]] - ay
    d = 2 * (bx * cy - by * cx)
    d = np.where(d == 0, 1e-300, d)
    px, py = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return ax + px, ay + py, np.hypot(px, py)


def _sure(g: pd.DataFrame) -> pd.DataFrame:
    """Triangles of one cell whose circles stay inside it; a side on the rim of the survey's box is open."""
    u, w, ids = g["u"].to_numpy(float), g["w"].to_numpy(float), g["id"].to_numpy()
    t = triangulate(u, w)
    side, cx, cy = 0.5 ** int(g["depth"].iloc[0]), int(g["cx"].iloc[0]), int(g["cy"].iloc[0])
    last = round(1 / side) - 1
    lo = [-np.inf if k == 0 else k * side for k in (cx, cy)]
    hi = [np.inf if k == last else (k + 1) * side for k in (cx, cy)]
    x, y, r = _circles(u, w, t) if len(t) else (np.zeros(0),) * 3
    kept = ids[t[(x - r >= lo[0]) & (x + r < hi[0]) & (y - r >= lo[1]) & (y + r < hi[1])]].reshape(-1, 3)
    return pd.DataFrame({"survey_id": g["survey_id"].iloc[0], "a": kept[:, 0], "b": kept[:, 1], "c": kept[:, 2]})


def _corners(tri: DataFrame, pts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(survey_id, p, a, b, c, begin, wide): at corner p of each triangle (of wanted points only, if given) the sector it takes, in radians from ``begin`` on."""
    each = tri.select("*", F.explode(F.array("a", "b", "c")).alias("p"))
    if wanted is not None:
        each = each.join(wanted.select("survey_id", F.col("id").alias("p")), ["survey_id", "p"], "left_semi")
    each = each.withColumns({"q": F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")), "s": F.when(F.col("p") == F.col("c"), F.col("b")).otherwise(F.col("c"))})
    for k in "pqs":
        each = each.join(pts.select("survey_id", F.col("id").alias(k), F.col("u").alias(f"u{k}"), F.col("w").alias(f"w{k}")), ["survey_id", k])
    turn = lambda k: F.atan2(F.col(f"w{k}") - F.col("wp"), F.col(f"u{k}") - F.col("up"))
    span = F.pmod(turn("s") - turn("q"), F.lit(2 * np.pi))
    return each.select("survey_id", "p", "a", "b", "c", F.when(span <= np.pi, turn("q")).otherwise(turn("s")).alias("begin"), F.least(span, 2 * np.pi - span).alias("wide"))


def delaunay(points: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(places (survey_id, id, x, y, v, u, w), triangles (survey_id, a, b, c) of their ids), both written. Fewer than three places, or all on a line, give none."""
    pts = written(_dedupe(points))
    left, done, n_left = pts, None, None
    while True:
        dealt = written(_cells(left.select("survey_id", "id", "u", "w"), most))
        found = written(dealt.groupBy("survey_id", "depth", "cx", "cy").applyInPandas(_sure, _TRI))
        if done is None:
            fresh = found
        else:  # without those on settled ground
            named = found.withColumn("t", F.monotonically_increasing_id())
            named = written(named)
            mine = _corners(named.select("survey_id", "a", "b", "c"), pts).where("p = a").select("survey_id", "p", "a", "b", "c", (F.col("begin") + F.col("wide") / 2).alias("mid"))
            old = _corners(done, pts, left).select("survey_id", "p", "begin", "wide")
            covered = mine.join(old, ["survey_id", "p"]).where(F.pmod(F.col("mid") - F.col("begin"), F.lit(2 * np.pi)) < F.col("wide")).select("survey_id", "a", "b", "c")
            fresh = found.join(covered, ["survey_id", "a", "b", "c"], "left_anti")
        done = written(fresh if done is None else done.unionByName(fresh))
        roots = dealt.where("depth > 0").select("survey_id").distinct()  # surveys that aren't one cell yet
        around = _corners(done, pts, left).groupBy("survey_id", F.col("p").alias("id")).agg(F.sum("wide").alias("turn")).where(F.col("turn") > 2 * np.pi - SLACK)
        left = written(left.join(roots, "survey_id", "left_semi").join(around, ["survey_id", "id"], "left_anti"))
        n = left.count()
        if not n:
            return pts, done
        if n_left is not None and n > 0.7 * n_left:
            most *= 2  # rims alone don't dwindle
        n_left = n


def _true_corners(pts: DataFrame, tri: DataFrame, *more: str) -> DataFrame:
    """Triangles with x, y, v (and more) of their corners as xa, ya, va, ...; without those that are flat at the true places."""
    out = tri
    for k in "abc":
        out = out.join(pts.select("survey_id", F.col("id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in ("x", "y", "v", *more)]), ["survey_id", k])
    area = (F.col("xb") - F.col("xa")) * (F.col("yc") - F.col("ya")) - (F.col("xc") - F.col("xa")) * (F.col("yb") - F.col("ya"))
    longest = F.greatest(*[F.pow(F.col(f"x{p}") - F.col(f"x{q}"), 2) + F.pow(F.col(f"y{p}") - F.col(f"y{q}"), 2) for p, q in ("ab", "bc", "ca")])
    return out.withColumn("area", area).where(F.abs("area") > 1e-9 * longest)


def _inside(tri: DataFrame, info: DataFrame) -> DataFrame:
    """Triangles with the lattice nodes inside them (iy, ix) and the nodes' weights la, lb, lc: line by line, so that only such nodes are made."""
    t = tri.join(settled(info), "survey_id")
    gap = lambda a: F.greatest((F.col(f"{a}_max") - F.col(f"{a}_min")) / F.greatest(F.col(f"n{a}") - 1, F.lit(1)), F.lit(1e-300))
    t = t.withColumns({"__dx": gap("x"), "__dy": gap("y")})
    row = lambda c: (F.col(c) - F.col("y_min")) / F.col("__dy")
    first, last = F.ceil(F.least(*map(row, ("ya", "yb", "yc"))) - SLACK), F.floor(F.greatest(*map(row, ("ya", "yb", "yc"))) + SLACK)
    lines = lambda lo, hi, n: F.when((lo <= hi) & (hi >= 0) & (lo < n), F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, n - 1).cast("int")))
    t = t.withColumn("iy", F.explode(lines(first, last, F.col("ny")))).withColumn("__y", F.col("y_min") + F.col("iy") * F.col("__dy"))

    def crossing(p: str, q: str) -> tuple[Column, Column]:
        """The part of edge pq on the node line, as a range of x."""
        low, high, y = F.least(f"y{p}", f"y{q}"), F.greatest(f"y{p}", f"y{q}"), F.least(F.greatest(F.col("__y"), F.least(f"y{p}", f"y{q}")), F.greatest(f"y{p}", f"y{q}"))
        meets = (F.col("__y") >= low - SLACK * F.col("__dy")) & (F.col("__y") <= high + SLACK * F.col("__dy"))
        at = F.col(f"x{p}") + (F.col(f"x{q}") - F.col(f"x{p}")) * F.try_divide(y - F.col(f"y{p}"), F.col(f"y{q}") - F.col(f"y{p}"))
        return F.when(meets, F.coalesce(at, F.least(f"x{p}", f"x{q}"))), F.when(meets, F.coalesce(at, F.greatest(f"x{p}", f"x{q}")))

    cut = [crossing(p, q) for p, q in ("ab", "bc", "ca")]
    column = lambda v: (v - F.col("x_min")) / F.col("__dx")
    first, last = F.ceil(column(F.least(*[c[0] for c in cut])) - SLACK), F.floor(column(F.greatest(*[c[1] for c in cut])) + SLACK)
    t = t.withColumn("ix", F.explode(lines(first, last, F.col("nx")))).withColumn("__x", F.col("x_min") + F.col("ix") * F.col("__dx"))
    share = lambda q, r: ((F.col(f"x{q}") - F.col("__x")) * (F.col(f"y{r}") - F.col("__y")) - (F.col(f"x{r}") - F.col("__x")) * (F.col(f"y{q}") - F.col("__y"))) / F.col("area")
    return t.withColumns({"la": share("b", "c"), "lb": share("c", "a"), "lc": share("a", "b")})


def _on_lattice(values: DataFrame, info: DataFrame) -> DataFrame:
    """One value per node (of the triangle with the smallest corners, where a node lies on an edge), NULL outside all triangles."""
    one = values.groupBy(*CELL).agg(F.min(F.struct("a", "b", "c", "z")).alias("s")).select(*CELL, F.col("s.z").alias("z"))
    return lattice(info).select(*CELL).join(one, CELL, "left")


def linear(points: DataFrame, info: DataFrame, most: int = MOST) -> DataFrame:
    """(survey_id, iy, ix, z): linear on Delaunay triangles; nodes outside all of them are NULL."""
    pts, tri = delaunay(points, most)
    near = _inside(_true_corners(pts, tri), info)
    return _on_lattice(near.select(*CELL, "a", "b", "c", (F.col("la") * F.col("va") + F.col("lb") * F.col("vb") + F.col("lc") * F.col("vc")).alias("z")), info)


# C1 cubic ------------------------------------------------------------------------------


def gradients(pts: DataFrame, tri: DataFrame, tolerance: float = 1e-6, steps: int = 4, most_rounds: int = 20) -> DataFrame:
    """pts with gx, gy: gradients that bend the edges' cubics least.

    Along an edge of length L in direction e the cubic with end values f and slopes s has the bending (4 / L) (s0^2 + s0 s1 + s1^2) - (12 / L^2) (f1 - f0) (s0 + s1) + ...;
    where their sum is least, every point's gradient solves two equations in which its neighbours' gradients stand. They are solved
    by turns: each step one join along edges and one aggregation by point, at least halving the error; ``steps`` of them are one job.
    """
    sides = F.array(*[F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in ("ab", "ba", "bc", "cb", "ca", "ac")])
    edges = _true_corners(pts, tri).select("survey_id", F.inline(sides)).distinct()
    for k in "pq":
        edges = edges.join(pts.select("survey_id", F.col("id").alias(k), *[F.col(c).alias(f"{c}{k}") for c in "xyv"]), ["survey_id", k])
    dx, dy = F.col("xq") - F.col("xp"), F.col("yq") - F.col("yp")
    edges = edges.select("survey_id", "p", "q", dx.alias("dx"), dy.alias("dy"), (F.col("vq") - F.col("vp")).alias("dv"), F.sqrt(dx * dx + dy * dy).alias("l"))
    edges = edges.select("survey_id", "p", "q", (F.col("dx") / F.col("l")).alias("ex"), (F.col("dy") / F.col("l")).alias("ey"), "dv", "l")
    edges = written(edges)
    own = edges.groupBy("survey_id", "p").agg(*[F.sum(F.lit(8.0) / F.col("l") * F.col(a) * F.col(b)).alias(n) for n, a, b in (("xx", "ex", "ex"), ("xy", "ex", "ey"), ("yy", "ey", "ey"))], *[F.sum(F.lit(12.0) * F.col("dv") / F.pow("l", F.lit(2)) * F.col(e)).alias(n) for n, e in (("rx", "ex"), ("ry", "ey"))])
    own = written(own)
    g = own.select("survey_id", "p", F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"))
    for _ in range(most_rounds):
        before = g
        for _ in range(steps):
            there = g.select("survey_id", F.col("p").alias("q"), "gx", "gy")
            slope = F.lit(4.0) / F.col("l") * (F.col("gx") * F.col("ex") + F.col("gy") * F.col("ey"))
            pull = edges.join(there, ["survey_id", "q"]).groupBy("survey_id", "p").agg(F.sum(slope * F.col("ex")).alias("sx"), F.sum(slope * F.col("ey")).alias("sy"))
            det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
            bx, by = F.col("rx") - F.col("sx"), F.col("ry") - F.col("sy")
            g = own.join(pull, ["survey_id", "p"]).select("survey_id", "p", F.coalesce(F.try_divide(F.col("yy") * bx - F.col("xy") * by, det), F.lit(0.0)).alias("gx"), F.coalesce(F.try_divide(F.col("xx") * by - F.col("xy") * bx, det), F.lit(0.0)).alias("gy"))
        g = written(g)
        moved = g.join(before.select("survey_id", "p", F.col("gx").alias("hx"), F.col("gy").alias("hy")), ["survey_id", "p"])
        r = moved.agg(F.max(F.greatest(F.abs(F.col("gx") - F.col("hx")), F.abs(F.col("gy") - F.col("hy")))).alias("d"), F.max(F.greatest(F.abs("gx"), F.abs("gy"))).alias("m")).first()
        if r["d"] is None or r["d"] <= tolerance * max(r["m"], 1e-300):
            break
    return pts.join(g.withColumnRenamed("p", "id"), ["survey_id", "id"], "left").na.fill(0.0, ["gx", "gy"])


def clough_tocher(x: np.ndarray, y: np.ndarray, v: np.ndarray, gx: np.ndarray, gy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values of C1 cubics: rows of three corners with value and gradient, at the weights of a place inside.

    The triangle is split at its centroid into three cubics. Their ordinates follow from the corners, from slopes across the edges that
    go straight from corner to corner, and from smoothness across the inner edges.
    """
    ox, oy = x.mean(1), y.mean(1)
    toward = v + (gx * (ox[:, None] - x) + gy * (oy[:, None] - y)) / 3
    near, far, inner = np.empty_like(v), np.empty_like(v), np.empty_like(v)
    for k in range(3):  # edge k goes from corner i to j, opposite to k
        i, j = (k + 1) % 3, (k + 2) % 3
        ex, ey = x[:, j] - x[:, i], y[:, j] - y[:, i]
        near[:, k] = v[:, i] + (gx[:, i] * ex + gy[:, i] * ey) / 3
        far[:, k] = v[:, j] - (gx[:, j] * ex + gy[:, j] * ey) / 3
        foot = ((ox - x[:, i]) * ex + (oy - y[:, i]) * ey) / (ex * ex + ey * ey)
        nx, ny = ox - x[:, i] - foot * ex, oy - y[:, i] - foot * ey
        across = ((gx[:, i] + gx[:, j]) * nx + (gy[:, i] + gy[:, j]) * ny) / 2
        inner[:, k] = across / 3 + (1 - foot) * near[:, k] + foot * far[:, k]
    spoke = (toward + inner[:, [1, 2, 0]] + inner[:, [2, 0, 1]]) / 3
    centre = spoke.mean(1)
    rows, k = np.arange(len(v)), weight.argmin(1)
    i, j = (k + 1) % 3, (k + 2) % 3
    p, q, c = weight[rows, i] - weight[rows, k], weight[rows, j] - weight[rows, k], 3 * weight[rows, k]
    return (
        v[rows, i] * p**3 + v[rows, j] * q**3 + centre * c**3 + 3 * near[rows, k] * p * p * q + 3 * far[rows, k] * p * q * q
        + 3 * toward[rows, i] * p * p * c + 3 * toward[rows, j] * q * q * c + 3 * spoke[rows, i] * p * c * c + 3 * spoke[rows, j] * q * c * c + 6 * inner[rows, k] * p * q * c
    )


def cubic(points: DataFrame, info: DataFrame, most: int = MOST) -> DataFrame:
    """(survey_id, iy, ix, z): C1 cubic on Delaunay triangles, for ``method='cubic'``; nodes outside all triangles are NULL."""
    pts, tri = delaunay(points, most)
    bent = written(gradients(pts, tri))
    near = _inside(_true_corners(bent, tri, "gx", "gy"), info)
    parts = [f"{c}{k}" for c in ("x", "y", "v", "gx", "gy", "l") for k in "abc"]

    def values(batches):
        for b in batches:
            at = [b[parts[i : i + 3]].to_numpy(float) for i in range(0, 18, 3)]
            yield b[[*CELL, "a", "b", "c"]].assign(z=clough_tocher(*at))

    return _on_lattice(near.select(*CELL, "a", "b", "c", *parts).mapInPandas(values, "survey_id string, iy int, ix int, a bigint, b bigint, c bigint, z double"), info)
