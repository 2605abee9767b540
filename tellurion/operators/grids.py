"""Operators on grids in long form (survey_id, iy, ix, z): lattices, index algebra, neighbourhoods.

Neighbourhood filters send each cell to the windows that it serves, mirrored cells included
(``... b a | a b c ...``), and aggregate there; sums over boxes go along one axis and then the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurion.model import step

from .points import KEY, median, with_aggregates
from .statistics import LEAST, group_stats, matched, settled

CELL = ["survey_id", "iy", "ix"]


def shape(df: DataFrame) -> DataFrame:
    return df.groupBy("survey_id").agg((F.max("ix") + 1).alias("nx"), (F.max("iy") + 1).alias("ny"))


def _shaped(df: DataFrame) -> DataFrame:
    return with_aggregates(df, KEY, __nx=F.max("ix") + 1, __ny=F.max("iy") + 1)


def grid_info(points: DataFrame, x_step: float, y_step: float, digits: int = 6) -> DataFrame:
    """Extents rounded to digits, and node counts rint(range / step) + 1."""
    r = lambda c: F.bround(c, digits)
    got = points.where("x is not null and y is not null").groupBy("survey_id").agg(r(F.min("x")).alias("x_min"), r(F.max("x")).alias("x_max"), r(F.min("y")).alias("y_min"), r(F.max("y")).alias("y_max"))
    n = lambda a, s: (F.rint((F.col(f"{a}_max") - F.col(f"{a}_min")) / F.lit(s)) + 1).cast("int")
    return got.select("survey_id", n("x", x_step).alias("nx"), n("y", y_step).alias("ny"), "x_min", "x_max", "y_min", "y_max")


def lattice(info: DataFrame) -> DataFrame:
    """All (iy, ix) of each survey with node coordinates."""
    node = lambda a: F.when(F.col(f"n{a}") > 1, F.col(f"{a}_min") + F.col(f"i{a}") * (F.col(f"{a}_max") - F.col(f"{a}_min")) / (F.col(f"n{a}") - 1)).otherwise(F.col(f"{a}_min"))
    rows = info.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    return rows.select("survey_id", "iy", "ix", node("x").alias("x"), node("y").alias("y"))


def bin_points(points: DataFrame, info: DataFrame, complete: bool = False) -> DataFrame:
    """Cell means over (ny-1) x (nx-1) cells between nodes, the last edges closed; with complete, empty cells are NULL."""
    p = points.join(settled(info), "survey_id")
    k = lambda a: F.least(F.floor((F.col(a) - F.col(f"{a}_min")) / ((F.col(f"{a}_max") - F.col(f"{a}_min")) / (F.col(f"n{a}") - 1))), F.col(f"n{a}") - 2).cast("int")
    inside = F.col("x").between(F.col("x_min"), F.col("x_max")) & F.col("y").between(F.col("y_min"), F.col("y_max"))
    got = p.where(inside & (F.col("nx") > 1) & (F.col("ny") > 1)).groupBy("survey_id", k("y").alias("iy"), k("x").alias("ix")).agg(F.avg("value").alias("z"))
    if complete:
        cells = info.where("nx > 1 and ny > 1").withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 2))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 2))).select(*CELL)
        got = cells.join(got, CELL, "left")
    return got


@step("rotate_grid", "grid")
def rotate(df: DataFrame, angle: int = 90) -> DataFrame:
    """Counter-clockwise by a multiple of 90 degrees; rows and columns swap at 90 and 270."""
    turns = {0: ("iy", "ix"), 90: ("__nx - 1 - ix", "iy"), 180: ("__ny - 1 - iy", "__nx - 1 - ix"), 270: ("ix", "__ny - 1 - iy")}
    if angle not in turns:
        raise ValueError("angle must be 0, 90, 180 or 270")
    y, x = turns[angle]
    s = _shaped(df).withColumns({"__y": F.expr(y).cast("int"), "__x": F.expr(x).cast("int")})
    return s.drop("iy", "ix").withColumnsRenamed({"__y": "iy", "__x": "ix"}).select(*df.columns)


def rotate_info(info: DataFrame, angle: int) -> DataFrame:
    if angle % 180 == 0:
        return info
    return info.selectExpr("survey_id", "ny as nx", "nx as ny", "y_min as x_min", "y_max as x_max", "x_min as y_min", "x_max as y_max")


@step("flip_grid", "grid")
def flip(df: DataFrame, direction: str = "horizontal") -> DataFrame:
    c, n = ("ix", "__nx") if direction == "horizontal" else ("iy", "__ny")
    return _shaped(df).withColumn(c, (F.col(n) - 1 - F.col(c)).cast("int")).select(*df.columns)


@step("crop_grid", "grid")
def crop(df: DataFrame, ix0: int | None = None, ix1: int | None = None, iy0: int | None = None, iy1: int | None = None) -> DataFrame:
    """Inclusive index bounds; indices start from 0 again."""
    for c, lo, hi in (("ix", ix0, ix1), ("iy", iy0, iy1)):
        if lo is not None:
            df = df.where(F.col(c) >= lo)
        if hi is not None:
            df = df.where(F.col(c) <= hi)
    out = with_aggregates(df, KEY, __x=F.min("ix"), __y=F.min("iy"))
    return out.withColumns({"ix": (F.col("ix") - F.col("__x")).cast("int"), "iy": (F.col("iy") - F.col("__y")).cast("int")}).select(*df.columns)


def crop_extent(df: DataFrame, info: DataFrame, xmin: float | None = None, xmax: float | None = None, ymin: float | None = None, ymax: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(grid, grid_info) of the nodes within inclusive coordinate bounds; those that are None are open."""
    s = df.select(*CELL, "z").join(settled(info), "survey_id")
    node = {a: F.when(F.col(f"n{a}") > 1, F.col(f"{a}_min") + F.col(f"i{a}") * (F.col(f"{a}_max") - F.col(f"{a}_min")) / (F.col(f"n{a}") - 1)).otherwise(F.col(f"{a}_min")) for a in "xy"}
    s = s.withColumns({"__x": node["x"], "__y": node["y"]})
    for c, lo, hi in (("__x", xmin, xmax), ("__y", ymin, ymax)):
        if lo is not None:
            s = s.where(F.col(c) >= F.lit(float(lo)))
        if hi is not None:
            s = s.where(F.col(c) <= F.lit(float(hi)))
    ends = s.groupBy("survey_id").agg((F.max("ix") - F.min("ix") + 1).cast("int").alias("nx"), (F.max("iy") - F.min("iy") + 1).cast("int").alias("ny"), F.min("__x").alias("x_min"), F.max("__x").alias("x_max"), F.min("__y").alias("y_min"), F.max("__y").alias("y_max"))
    return crop(s.select(*CELL, "z")), ends


def as_rows(df: DataFrame, info: DataFrame) -> DataFrame:
    """Grid as (survey_id, x, y, value): a row per node, with its coordinates."""
    return lattice(info).join(df.select(*CELL, F.col("z").alias("value")), CELL, "left").select("survey_id", "x", "y", "value")


def describe(df: DataFrame, info: DataFrame) -> DataFrame:
    """One row per survey of what file heads need: nrow, ncol, extents, cell sizes, and zmin and zmax as they are now."""
    z = df.groupBy("survey_id").agg(F.min("z").alias("zmin"), F.max("z").alias("zmax"))
    size = lambda a: F.try_divide(F.col(f"{a}_max") - F.col(f"{a}_min"), F.col(f"n{a}") - 1).alias(f"{a}size")
    return info.join(z, "survey_id").select("survey_id", F.col("ny").alias("nrow"), F.col("nx").alias("ncol"), *[F.col(f"{a}_{m}").alias(f"{a}{m}") for a in "xy" for m in ("min", "max")], size("x"), size("y"), "zmin", "zmax")


def translate_info(info: DataFrame, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    return info.withColumns({c: F.col(c) + F.lit(float(d)) for c, d in (("x_min", dx), ("x_max", dx), ("y_min", dy), ("y_max", dy))})


@step("shift_profiles", "grid")
def shift(df: DataFrame, n: int, roll: bool = False, fill: float | None = None) -> DataFrame:
    """Move each column by n rows, filling with a value, or around the end."""
    s = _shaped(df)
    if roll:
        return s.withColumn("iy", F.pmod(F.col("iy") + n, F.col("__ny")).cast("int")).select(*df.columns)
    w = Window.partitionBy("survey_id", "ix").orderBy("iy")
    moved = F.lag("z", n).over(w) if n >= 0 else F.lead("z", -n).over(w)
    edge = F.col("iy") < n if n >= 0 else F.col("iy") >= F.col("__ny") + n
    return s.withColumn("z", F.when(edge, F.lit(fill).cast("double")).otherwise(moved)).select(*df.columns)


def _mirrored(at: Column, size: Column, lo: int, hi: int) -> Column:
    """Where a cell stands in the grid and its mirror images as far as windows reach."""
    turns = F.ceil(F.lit(max(-lo, hi, 1)) / (2 * size)).cast("int")
    return F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(2 * size * k + at, 2 * size * k - 1 - at)))


def neighbours(df: DataFrame, ry0: int, ry1: int, rx0: int, rx1: int) -> DataFrame:
    """(survey_id, iy, ix, v): for every cell the values of rows iy+ry0..iy+ry1, columns ix+rx0..ix+rx1, mirrored at the rim.

    Windows may be larger than the grid: mirroring goes on with period 2n.
    """
    s = _shaped(df)

    def served(c: str, n: str, lo: int, hi: int) -> Column:
        at, size = F.col(c), F.col(n)
        images = _mirrored(at, size, lo, hi)  # where a cell stands, and its mirror images
        targets = F.flatten(F.transform(images, lambda m: F.sequence(m - F.lit(hi), m - F.lit(lo))))
        return F.filter(targets, lambda t: (t >= 0) & (t < size))

    s = s.withColumn("__ty", F.explode(served("iy", "__ny", ry0, ry1))).withColumn("__tx", F.explode(served("ix", "__nx", rx0, rx1)))
    return s.select("survey_id", F.col("__ty").cast("int").alias("iy"), F.col("__tx").cast("int").alias("ix"), F.col("z").alias("v"))


def _window(size: int) -> tuple[int, int]:
    return -(size // 2), size - 1 - size // 2


def _rank_median(v: Column, even: bool) -> Column:
    """Middle value; of an even number the upper one, as rank filters take it."""
    return F.element_at(F.array_sort(F.collect_list(v)), (F.floor(F.count(v) / 2) + 1).cast("int")) if even else median(v)


def local_median(df: DataFrame, size: tuple[int, int]) -> DataFrame:
    even = size[0] * size[1] % 2 == 0
    return neighbours(df, *_window(size[0]), *_window(size[1])).groupBy(*CELL).agg(_rank_median(F.col("v"), even).alias("m"))


@step("median_filter_2d_grid", "grid")
def median_filter(df: DataFrame, window: tuple[int, int] = (5, 5), threshold: float = 0.0, mode: str = "relative") -> DataFrame:
    """Window is (rows, columns). Threshold 0 replaces all, else only cells off by more (relative: times the median)."""
    out = df.join(local_median(df, window), CELL)
    bound = F.abs(F.lit(float(threshold)) * F.col("m")) if mode == "relative" else F.lit(float(threshold))
    new = F.col("m") if threshold == 0 else F.when(F.abs(F.col("z") - F.col("m")) > bound, F.col("m")).otherwise(F.col("z"))
    return out.withColumn("z", new).select(*df.columns)


@step("hampel_filter_2d_grid", "grid")
def hampel_filter(df: DataFrame, window: tuple[int, int] = (3, 3), threshold: float = 3.0) -> DataFrame:
    """Deviations from the local median against 1.4826 times their own local median."""
    dev = df.join(local_median(df, window), CELL).withColumn("__d", F.abs(F.col("z") - F.col("m")))
    mad = local_median(dev.select(*CELL, F.col("__d").alias("z")), window).withColumnRenamed("m", "__mad")
    out = dev.join(mad, CELL)
    return out.withColumn("z", F.when(F.col("__d") > F.lit(1.4826 * threshold) * F.col("__mad"), F.col("m")).otherwise(F.col("z"))).select(*df.columns)


def box_sums(df: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(cell, n, s, ss): count, sum and sum of squares over mirrored windows: rows first, then columns."""
    (y0, y1), (x0, x1) = _window(size[0]), _window(size[1])
    parts = {"n": F.col("z").isNotNull().cast("double"), "s": F.coalesce("z", F.lit(0.0)), "ss": F.coalesce(F.col("z") * F.col("z"), F.lit(0.0))}

    def along(d: DataFrame, c: str, n: str, lo: int, hi: int) -> DataFrame:
        at, m = F.col(c), F.col(n)
        images = _mirrored(at, m, lo, hi)
        near = F.filter(images, lambda i: (i >= lo) & (i < m + hi))  # mirrored padding rows, then one running sum
        other = "ix" if c == "iy" else "iy"
        w = Window.partitionBy("survey_id", other).orderBy("__p").rangeBetween(lo, hi)
        d = d.withColumn("__p", F.explode(F.array_distinct(near)))
        d = d.withColumns({f"__{k}": F.sum(k).over(w) for k in parts})
        d = d.where((F.col("__p") >= 0) & (F.col("__p") < m))
        return d.select("survey_id", F.col("__p").cast("int").alias(c), other, "__nx", "__ny", *[F.col(f"__{k}").alias(k) for k in parts])

    d = _shaped(df).select(*CELL, "__nx", "__ny", *[v.alias(k) for k, v in parts.items()])
    return along(along(d, "iy", "__ny", y0, y1), "ix", "__nx", x0, x1).select(*CELL, *parts)


@step("separate_grid_trends", "grid")
def separate_trends(df: DataFrame, window: tuple[int, int] = (5, 5), component: str = "local", method: str = "additive") -> DataFrame:
    """Regional part: window means; local part: what is left, or z * mean / regional ('relative')."""
    out = df.join(box_sums(df, window), CELL).withColumn("__t", F.try_divide(F.col("s"), F.col("n")))
    if component == "regional":
        return out.withColumn("z", F.col("__t")).select(*df.columns)
    if method == "relative":
        out = with_aggregates(out, KEY, __m=F.avg("z"))
        return out.withColumn("z", F.col("z") * F.col("__m") / F.when(F.col("__t") == 0, 1e-9).otherwise(F.col("__t"))).select(*df.columns)
    return out.withColumn("z", F.col("z") - F.col("__t")).select(*df.columns)


def wallis(df: DataFrame, window: int | tuple[int, int] = 31, mean: float = 0.0, stdev: float = 1.0, floor: float = 0.1) -> DataFrame:
    """Local mean and deviation to targets; deviations count as floor times the largest at least."""
    out = df.join(box_sums(df, (window, window) if isinstance(window, int) else tuple(window)), CELL)
    m = F.try_divide(F.col("s"), F.col("n"))
    out = out.withColumns({"__m": m, "__s": F.sqrt(F.greatest(F.try_divide(F.col("ss"), F.col("n")) - m * m, F.lit(0.0)))})
    out = with_aggregates(out, KEY, __top=F.max("__s"))
    gain = F.try_divide(F.lit(float(stdev)), F.greatest(F.col("__s"), F.col("__top") * F.lit(float(floor))))
    return out.withColumn("z", F.coalesce(gain, F.lit(0.0)) * (F.col("z") - F.col("__m")) + F.lit(float(mean))).select(*df.columns)


@step("wallis_filter_grid", "grid")
def wallis_step(df: DataFrame, window_size: tuple[int, int] = (31, 31), target_mean: float = 127.0, target_stdev: float = 50.0, limit_stdev_factor: float = 0.8) -> DataFrame:
    """The recipe step, by the names and defaults that recipes have."""
    return wallis(df, window_size, target_mean, target_stdev, limit_stdev_factor)


def wallis_levels(df: DataFrame, nx: int = 5, ny: int = 5, mean: float = 127.0, stdev: float = 40.0, gain: float = 8.0, edge: float = 0.1, limit: float = 25.0, levels: int = 256) -> DataFrame:
    """Older variant on integer levels, windows cut off at the rim: the new level blends target and local
    statistics, local deviations are capped at limit, and the result goes back to values."""
    from .points import to_levels

    lev = to_levels(df, levels).withColumn("l", F.col("level").cast("double"))
    wy = Window.partitionBy("survey_id", "ix").orderBy("iy").rangeBetween(-ny, ny)
    wx = Window.partitionBy("survey_id", "iy").orderBy("ix").rangeBetween(-nx, nx)
    out = lev.withColumns({"__n": F.count("l").over(wy).cast("double"), "__s": F.sum("l").over(wy), "__q": F.sum(F.col("l") * F.col("l")).over(wy)})
    out = out.withColumns({k: F.sum(k).over(wx) for k in ("__n", "__s", "__q")})
    m = F.col("__s") / F.col("__n")
    s = F.least(F.sqrt(F.greatest(F.col("__q") / F.col("__n") - m * m, F.lit(0.0))), F.lit(limit))
    new = (F.col("l") - m) * F.lit(gain * stdev) / (F.lit(gain) * s + F.lit(stdev)) + F.lit(edge * mean) + F.lit(1 - edge) * m
    out = with_aggregates(out.withColumn("__new", F.greatest(F.least(new, F.lit(levels - 1.0)), F.lit(0.0))), KEY, __lo=F.min("z"), __hi=F.max("z"))
    return out.withColumn("z", F.col("__lo") + F.col("__new") * (F.col("__hi") - F.col("__lo")) / levels).select(*df.columns)


@step("clahe_filter_grid", "grid")
def clahe(df: DataFrame, kernel: tuple[int, int] = (8, 8), clip: float = 0.01, bins: int = 256) -> DataFrame:
    """Contrast-limited adaptive equalisation: clipped histograms of kernel-sized tiles, their cumulated shares
    mixed bilinearly from the four nearest tiles, and the survey's range kept.

    The histograms go to the meshes between tile centres, four to a mesh, and each cell goes to its mesh once.
    """
    ky, kx = kernel
    ends = group_stats(df, KEY, __lo=F.min("z"), __hi=F.max("z"), __nx=F.max("ix") + 1, __ny=F.max("iy") + 1)

    def binned(d: DataFrame) -> DataFrame:
        unit = F.coalesce(F.try_divide(F.col("z") - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.when(F.col("z").isNotNull(), F.lit(0.0)))
        return matched(d, ends, KEY).withColumn("__b", F.least(F.floor(unit * bins), F.lit(bins - 1)).cast("int"))

    tile = ["survey_id", "__ty", "__tx"]
    h = binned(df).select("survey_id", F.floor(F.col("iy") / ky).cast("int").alias("__ty"), F.floor(F.col("ix") / kx).cast("int").alias("__tx"), "__b")
    if ky * kx <= LEAST:  # a tile's cells meet once, as counting them before would hardly make them fewer
        h = h.repartition(*tile)
    h = h.groupBy(*tile, "__b").agg(F.count("*").alias("c"))
    whole, rising = Window.partitionBy(*tile), Window.partitionBy(*tile).orderBy("__b")
    h = h.withColumn("__n", F.sum("c").over(whole))
    h = h.withColumn("__cut", F.least(F.col("c").cast("double"), F.greatest(F.lit(1.0), F.lit(float(clip)) * F.col("__n"))))
    h = h.withColumns({"__over": F.sum("c").over(whole) - F.sum("__cut").over(whole), "__cum": F.sum("__cut").over(rising), "__run": F.lead("__b", 1, bins).over(rising) - F.col("__b")})
    maps = h.groupBy(*tile).agg(F.array_sort(F.collect_list(F.struct("__b", "__run", "__cum"))).alias("m"), F.first("__over").alias("over"), F.first("__n").alias("n"))
    maps = maps.select(*tile, F.struct(F.concat(F.array(F.col("m")[0]["__b"]), "m.__run").alias("run"), F.concat(F.array(F.lit(0.0)), "m.__cum").alias("cum"), "over", "n").alias("m"))

    def served(t: str, last: Column) -> Column:
        """(g, d) of the meshes of tile centres, from -1 to last, whose corner d a tile is; at the rim it stands for those beyond it."""
        at, on = F.col(t), lambda g, d: F.struct(F.lit(g).cast("int").alias("g"), F.lit(d).alias("d"))
        return F.array_compact(F.array(on(at, 0), on(at - 1, 1), F.when(at == 0, on(-1, 0)), F.when(at == last, on(at, 1))))

    maps = matched(maps, ends, KEY).withColumn("y", F.explode(served("__ty", F.floor((F.col("__ny") - 1) / ky)))).withColumn("x", F.explode(served("__tx", F.floor((F.col("__nx") - 1) / kx))))
    mesh = ["survey_id", "__gy", "__gx"]
    four = [F.first(F.when((F.col("y.d") == dy) & (F.col("x.d") == dx), F.col("m")), ignorenulls=True).alias(f"__m{dy}{dx}") for dy in (0, 1) for dx in (0, 1)]
    meshes = maps.groupBy("survey_id", F.col("y.g").alias("__gy"), F.col("x.g").alias("__gx")).agg(*four)

    def level(m: Column) -> Column:
        """Cumulated counts of all bins, over and n."""
        return F.when(m.isNotNull(), F.struct(F.flatten(F.zip_with(m["cum"], m["run"], F.array_repeat)).alias("below"), m["over"].alias("over"), m["n"].alias("n")))

    meshes = meshes.withColumns({c: level(F.col(c)) for c in meshes.columns if c not in mesh})
    fy, fx = (F.col("iy") - (ky - 1) / 2) / ky, (F.col("ix") - (kx - 1) / 2) / kx
    spot = binned(df.withColumns({"__gy": F.floor(fy).cast("int"), "__gx": F.floor(fx).cast("int")}).join(meshes, mesh, "left"))
    mixed = F.lit(0.0)
    for dy in (0, 1):
        for dx in (0, 1):
            m = F.col(f"__m{dy}{dx}")
            share = (F.get(m["below"], F.col("__b")) + m["over"] * (F.col("__b") + 1) / bins) / m["n"]
            wy, wx = (fy - F.floor(fy) if dy else 1 - (fy - F.floor(fy))), (fx - F.floor(fx) if dx else 1 - (fx - F.floor(fx)))
            mixed = mixed + wy * wx * F.coalesce(share, F.lit(0.0))
    return spot.withColumn("z", F.when(F.col("z").isNotNull(), F.col("__lo") + mixed * (F.col("__hi") - F.col("__lo")))).select(*df.columns)


# tile masks ------------------------------------------------------------------


def tile_index(col: str, low: Column, size: Column, n: int) -> Column:
    return F.greatest(F.least((F.ceil((F.col(col) - low) / size - 0.5) - 1).cast("int"), F.lit(n - 1)), F.lit(0))


def disc_kernel(radius: int, power: float = 0.0) -> list[tuple[int, int, float]]:
    """(dy, dx, weight) within radius; weights ((1 + r - d) / (1 + r)) ** power."""
    out = []
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            d = float(np.hypot(dy, dx))
            if d <= radius:
                out.append((dy, dx, ((1 + radius - d) / (1 + radius)) ** power))
    return out


def tile_density(points: DataFrame, n: int = 100, radius: int = 2, power: float = 0.0) -> DataFrame:
    """(survey_id, iy, ix, density): points near each of n x n tiles, by kernel weight, over r^2 / 3; the kernel is a constant array."""
    p = with_aggregates(points, KEY, __x0=F.min("x"), __x1=F.max("x"), __y0=F.min("y"), __y1=F.max("y"))
    size = lambda a: F.when(F.col(f"__{a}1") > F.col(f"__{a}0"), (F.col(f"__{a}1") - F.col(f"__{a}0")) / n).otherwise(1.0)
    tiles = p.groupBy("survey_id", tile_index("y", F.col("__y0"), size("y"), n).alias("ty"), tile_index("x", F.col("__x0"), size("x"), n).alias("tx")).agg(F.count("*").alias("c"))
    kernel = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(float(w)).alias("w")) for a, b, w in disc_kernel(radius, power)])
    spread = tiles.withColumn("k", F.explode(kernel)).select("survey_id", (F.col("ty") + F.col("k.dy")).alias("iy"), (F.col("tx") + F.col("k.dx")).alias("ix"), (F.col("c") * F.col("k.w")).alias("w"))
    spread = spread.where(F.col("iy").between(0, n - 1) & F.col("ix").between(0, n - 1))
    return spread.groupBy(*CELL).agg((F.sum("w") / F.lit(max(radius * radius, 1) / 3.0)).alias("density"))


def tile_mask(points: DataFrame, n: int = 100, radius: int = 2, power: float = 0.0) -> DataFrame:
    """Tiles with enough points near: density above 1 (to nine decimals, so that the order of sums can't decide)."""
    return tile_density(points, n, radius, power).where("round(density, 9) > 1").select(*CELL)


def tile_mask_round(points: DataFrame, n: int = 100, radius: int = 3) -> DataFrame:
    """Tiles with points all round: the mean offset of near tiles with points is below (r + 1) / 2 and
    no empty sector reaches half a turn (to nine decimals)."""
    dens = points.select("survey_id", "x", "y")
    p = with_aggregates(dens, KEY, __x0=F.min("x"), __x1=F.max("x"), __y0=F.min("y"), __y1=F.max("y"))
    size = lambda a: F.when(F.col(f"__{a}1") > F.col(f"__{a}0"), (F.col(f"__{a}1") - F.col(f"__{a}0")) / n).otherwise(1.0)
    tiles = p.select("survey_id", tile_index("y", F.col("__y0"), size("y"), n).alias("ty"), tile_index("x", F.col("__x0"), size("x"), n).alias("tx")).distinct()
    kernel = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b, _ in disc_kernel(radius)])
    near = tiles.withColumn("k", F.explode(kernel)).select("survey_id", (F.col("ty") + F.col("k.dy")).alias("iy"), (F.col("tx") + F.col("k.dx")).alias("ix"), (-F.col("k.dy")).alias("oy"), (-F.col("k.dx")).alias("ox"))
    near = near.where(F.col("iy").between(0, n - 1) & F.col("ix").between(0, n - 1))
    turn = F.when((F.col("oy") != 0) | (F.col("ox") != 0), F.atan2(F.col("oy"), F.col("ox")))
    got = near.groupBy(*CELL).agg(F.avg("oy").alias("my"), F.avg("ox").alias("mx"), F.array_sort(F.collect_set(turn)).alias("a"))
    two_pi = 2 * np.pi
    gaps = F.concat(F.zip_with(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), F.slice("a", 1, F.greatest(F.size("a") - 1, F.lit(0))), lambda b, c: b - c), F.array(F.element_at("a", 1) + F.lit(two_pi) - F.element_at("a", -1)))
    got = got.where(F.size("a") > 1).where((F.sqrt(F.col("my") ** 2 + F.col("mx") ** 2) < (radius + 1) / 2) & (F.round(F.array_max(gaps), 9) < F.round(F.lit(np.pi), 9)))
    return got.select(*CELL)


def to_frame(g: pd.DataFrame) -> np.ndarray:
    """Dense array of one survey's cells; NULL is NaN."""
    out = np.full((int(g["iy"].max()) + 1, int(g["ix"].max()) + 1), np.nan)
    out[g["iy"].to_numpy(int), g["ix"].to_numpy(int)] = g["z"].to_numpy(float)
    return out
