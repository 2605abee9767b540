"""Spectral and magnetic operators on grids.

A two-dimensional transform is one shuffle by row and one by column; each task holds single rows or
columns, so a grid is never gathered whole. Filters are column expressions on (re, im).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.model import step

from .grids import CELL
from .points import KEY, with_aggregates

_COMPLEX = "struct<re:array<double>,im:array<double>>"


def wavenumber(k: Column, n: Column, d: Column | float) -> Column:
    """Cycles per unit of the k-th of n transform terms at spacing d."""
    m = F.when(k <= F.floor((n - 1) / 2), k).otherwise(k - n)
    return m.cast("double") / (n.cast("double") * (d if isinstance(d, Column) else F.lit(float(d))))


def wavenumbers(df: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """(cell, u, v) wavenumbers for a grid's shape."""
    s = with_aggregates(df, KEY, nx=F.max("ix") + 1, ny=F.max("iy") + 1)
    return s.select(*CELL, wavenumber(F.col("ix"), F.col("nx"), dx).alias("u"), wavenumber(F.col("iy"), F.col("ny"), dy).alias("v"))


def tukey(i: Column, n: Column, width: float) -> Column:
    """Tapered cosine window, a share ``width`` at each end."""
    a = min(2.0 * width, 1.0)
    if a <= 0:
        return F.lit(1.0)
    x = i.cast("double") / F.greatest(n - 1, F.lit(1)).cast("double")
    edge = F.least(x, 1 - x)
    return F.when(n <= 1, F.lit(1.0)).when(edge < a / 2, 0.5 * (1 + F.cos(F.lit(np.pi) * (2 * edge / F.lit(a) - 1)))).otherwise(1.0)


@step("apodize_grid", "grid")
def apodize(df: DataFrame, width: float = 0.1) -> DataFrame:
    s = with_aggregates(df, KEY, __nx=F.max("ix") + 1, __ny=F.max("iy") + 1)
    return s.withColumn("z", F.col("z") * tukey(F.col("ix"), F.col("__nx"), width) * tukey(F.col("iy"), F.col("__ny"), width)).select(*df.columns)


def pad_cosine(df: DataFrame, n: int) -> DataFrame:
    """Grow the grid by n cells on each side, mirrored and faded out by a half cosine."""
    s = with_aggregates(df, KEY, __nx=F.max("ix") + 1, __ny=F.max("iy") + 1)

    def images(c: str, m: str) -> Column:
        at, size = F.col(c), F.col(m)
        return F.array_distinct(F.filter(F.array(at, -1 - at, 2 * size - 1 - at), lambda p: (p >= -n) & (p < size + n)))

    s = s.withColumn("__y", F.explode(images("iy", "__ny"))).withColumn("__x", F.explode(images("ix", "__nx")))

    def fade(c: str, m: str) -> Column:
        out = F.greatest(-F.col(c), F.col(c) - F.col(m) + 1, F.lit(0))
        return 0.5 * (1 + F.cos(F.lit(np.pi) * out / F.lit(n + 1.0)))

    return s.select("survey_id", (F.col("__y") + n).cast("int").alias("iy"), (F.col("__x") + n).cast("int").alias("ix"), (F.col("z") * fade("__y", "__ny") * fade("__x", "__nx")).alias("z"))


def unpad(df: DataFrame, n: int) -> DataFrame:
    s = with_aggregates(df, KEY, __nx=F.max("ix") + 1, __ny=F.max("iy") + 1)
    s = s.where(F.col("ix").between(n, F.col("__nx") - n - 1) & F.col("iy").between(n, F.col("__ny") - n - 1))
    return s.select("survey_id", (F.col("iy") - n).cast("int").alias("iy"), (F.col("ix") - n).cast("int").alias("ix"), "z")


def _transformer(inverse: bool) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(_COMPLEX)
    def run(re: pd.Series, im: pd.Series) -> pd.DataFrame:
        f = np.fft.ifft if inverse else np.fft.fft
        out = [f(np.asarray(a, float) + 1j * np.asarray(b, float)) for a, b in zip(re, im, strict=True)]
        return pd.DataFrame({"re": [o.real for o in out], "im": [o.imag for o in out]})

    return run


def _along(df: DataFrame, line: str, place: str, inverse: bool) -> DataFrame:
    """Transform each line of (survey_id, line, place, re, im, *rest of the survey)."""
    rest = [c for c in df.columns if c not in ("survey_id", line, place, "re", "im")]
    g = df.groupBy("survey_id", line).agg(F.array_sort(F.collect_list(F.struct(place, "re", "im"))).alias("a"), *[F.first(c).alias(c) for c in rest])
    g = g.withColumn("t", _transformer(inverse)(F.transform("a", lambda s: s["re"]), F.transform("a", lambda s: s["im"])))
    g = g.select("survey_id", line, *rest, F.posexplode(F.arrays_zip("t.re", "t.im")).alias(place, "p"))
    return g.select("survey_id", line, place, F.col("p.re").alias("re"), F.col("p.im").alias("im"), *rest)


def fft2(df: DataFrame, taper: float = 0.0) -> DataFrame:
    """(survey_id, ky, kx, re, im, nx, ny, mean): NULLs become the mean, the mean goes, edges are tapered."""
    s = with_aggregates(df, KEY, nx=F.max("ix") + 1, ny=F.max("iy") + 1, mean=F.avg("z"))
    z = F.coalesce(F.col("z") - F.col("mean"), F.lit(0.0)) * tukey(F.col("ix"), F.col("nx"), taper) * tukey(F.col("iy"), F.col("ny"), taper)
    rows = _along(s.select(*CELL, z.alias("re"), F.lit(0.0).alias("im"), "nx", "ny", "mean"), "iy", "ix", False).withColumnRenamed("ix", "kx")
    return _along(rows, "kx", "iy", False).withColumnRenamed("iy", "ky")


def ifft2(spec: DataFrame, value: str = "z") -> DataFrame:
    """(survey_id, iy, ix, value, mean): real part of the inverse transform."""
    cols = _along(spec.select("survey_id", "ky", "kx", "re", "im", "mean"), "kx", "ky", True).withColumnRenamed("ky", "iy")
    out = _along(cols, "iy", "kx", True).withColumnRenamed("kx", "ix")
    return out.select("survey_id", F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), F.col("re").alias(value), "mean")


class Freq:
    """Wavenumbers of a spectrum's rows in cycles per unit, and its complex products."""

    def __init__(self, dx: float, dy: float):
        self.u, self.v = wavenumber(F.col("kx"), F.col("nx"), dx), wavenumber(F.col("ky"), F.col("ny"), dy)
        self.r = F.sqrt(self.u * self.u + self.v * self.v)
        self.k = F.lit(2 * np.pi) * self.r


def times(spec: DataFrame, re: Column, im: Column | None = None) -> DataFrame:
    im = F.lit(0.0) if im is None else im
    a, b = F.col("re"), F.col("im")
    return spec.withColumns({"__a": a * re - b * im, "__b": a * im + b * re}).drop("re", "im").withColumnsRenamed({"__a": "re", "__b": "im"})


def over(re: Column, im: Column) -> tuple[Column, Column]:
    """1 / (re + i im), 0 where that is 0."""
    d = re * re + im * im
    return F.coalesce(F.try_divide(re, d), F.lit(0.0)), F.coalesce(F.try_divide(-im, d), F.lit(0.0))


def _back(df: DataFrame, spec: DataFrame, add_mean: bool) -> DataFrame:
    out = ifft2(spec, "__z")
    z = F.col("__z") + F.col("mean") if add_mean else F.col("__z")
    return df.join(out, CELL).withColumn("z", F.when(F.col("z").isNotNull(), z)).select(*df.columns)


@step("continue_field_grid", "grid")
def continue_field(df: DataFrame, height: float, dx: float = 1.0, dy: float = 1.0, taper: float = 0.0) -> DataFrame:
    """Up (height > 0) or down: factor exp(-2 pi height |k|); the mean and NULLs come back."""
    return _back(df, times(fft2(df, taper), F.exp(F.lit(-float(height)) * Freq(dx, dy).k)), True)


def derivatives(df: DataFrame, dx: float = 1.0, dy: float = 1.0, taper: float = 0.0) -> DataFrame:
    """(cell, tx, ty, tz): spectral derivatives; tz is 2 pi |k|. The three go back through one inverse transform."""
    f = Freq(dx, dy)
    two = F.lit(2 * np.pi)
    re, im = F.col("re"), F.col("im")
    parts = {"tx": (-im * two * f.u, re * two * f.u), "ty": (-im * two * f.v, re * two * f.v), "tz": (re * f.k, im * f.k)}
    spec = fft2(df, taper).withColumn("p", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), a.alias("a"), b.alias("b")) for c, (a, b) in parts.items()])))
    spec = spec.select(F.struct("survey_id", "p.c").alias("survey_id"), "ky", "kx", F.col("p.a").alias("re"), F.col("p.b").alias("im"), "mean")
    out = ifft2(spec).select("survey_id.survey_id", "iy", "ix", F.col("survey_id.c").alias("c"), "z")
    return out.groupBy(*CELL).agg(*[F.max(F.when(F.col("c") == c, F.col("z"))).alias(c) for c in parts])


@step("analytic_signal_grid", "grid")
def analytic_signal(df: DataFrame, dx: float = 1.0, dy: float = 1.0, taper: float = 0.0) -> DataFrame:
    d = derivatives(df, dx, dy, taper)
    z = F.sqrt(F.col("tx") ** 2 + F.col("ty") ** 2 + F.col("tz") ** 2)
    return df.join(d, CELL).withColumn("z", F.when(F.col("z").isNotNull(), z)).select(*df.columns)


@step("reduction_to_the_pole_grid", "grid")
def reduce_to_pole(df: DataFrame, inclination: float, declination: float, dx: float = 1.0, dy: float = 1.0, taper: float = 0.0, mag_inclination: float | None = None, mag_declination: float | None = None) -> DataFrame:
    """1 / (F M) with F = sin I + i cos I cos(D - angle of k) of the field and M that of the magnetisation, the field's
    where it isn't given (no remanence); the mean term is 0."""
    f = Freq(dx, dy)

    def part(inc: float, dec: float) -> tuple[Column, Column]:
        i, d = np.radians(inc), np.radians(dec)
        return F.lit(float(np.sin(i))), F.lit(float(np.cos(i))) * F.cos(F.lit(float(d)) - F.atan2(f.v, f.u))

    (a, b), (c, d) = part(inclination, declination), part(inclination if mag_inclination is None else mag_inclination, declination if mag_declination is None else mag_declination)
    re, im = over(a * c - b * d, a * d + b * c)
    zero = (F.col("kx") == 0) & (F.col("ky") == 0)
    return _back(df, times(fft2(df, taper), F.when(zero, 0.0).otherwise(re), F.when(zero, 0.0).otherwise(im)), False)


def direction_cosines(inclination: float, declination: float, azimuth: float) -> tuple[float, float, float]:
    i, a = np.radians(inclination), np.radians(declination - azimuth)
    return float(np.cos(i) * np.cos(a)), float(np.cos(i) * np.sin(a)), float(np.sin(i))


CONFIGURATIONS = ("TotalField", "Gradient", "Fluxgate")


@step("convert_sensor_grid", "grid")
def convert_sensor(df: DataFrame, source: str, target: str, separation: float = 0.7, inclination: float = 65.0, declination: float = 0.0, azimuth: float = 0.0, z0: float | None = None, znew: float | None = None, dx: float = 1.0, dy: float = 1.0, taper: float = 0.0) -> DataFrame:
    """From one magnetometer set-up to another; the term of wavenumber 0 becomes 0.

    Field to gradient: 1 - exp(-s k), or exp(-dh k) - exp(-(dh + s) k) at a new height. Gradient to fluxgate: k over
    (k fz + i (kx fx + ky fy)). The others are inverses and products of these.
    """
    if source not in CONFIGURATIONS or target not in CONFIGURATIONS:
        raise ValueError(f"configurations are {CONFIGURATIONS}")
    f = Freq(dx, dy)

    def climb(h: float) -> Column:
        return F.exp(F.lit(-abs(h) if h >= 0 else abs(h)) * f.k)

    grad = climb(znew - z0) - climb(znew - z0 + separation) if z0 is not None and znew is not None else 1 - climb(separation)
    fx, fy, fz = direction_cosines(inclination, declination, azimuth)
    two = F.lit(2 * np.pi)
    gate = over(F.lit(fz), F.coalesce(F.try_divide(two * (f.u * fx + f.v * fy), f.k), F.lit(0.0)))
    spec = fft2(df, taper)
    order = {"TotalField": 0, "Gradient": 1, "Fluxgate": 2}
    a, b = order[source], order[target]
    if a < b:
        if a == 0:
            spec = times(spec, grad)
        if b == 2:
            spec = times(spec, *gate)
    elif a > b:
        if a == 2:
            spec = times(spec, *over(*gate))
        if b == 0:
            spec = times(spec, *over(grad, F.lit(0.0)))
    zero = F.when((F.col("kx") == 0) & (F.col("ky") == 0), 0.0).otherwise(1.0)
    return _back(df, times(spec, zero) if a != b else spec, a == b)


@step("plough_filter_grid", "grid")
def plough_filter(df: DataFrame, angle: float, power: float = 2.0, cutoff: float | None = None, dx: float = 1.0, dy: float = 1.0, taper: float = 0.0) -> DataFrame:
    """Suppress stripes along a direction: exp(-(r/fc)^2) times 1 - exp(-r^2 / |tan phi|^n), phi the angle to the direction's
    wavenumber axis; where |phi| <= 45 degrees only the low-pass acts."""
    f = Freq(dx, dy)
    t = F.lit(float(np.radians(angle)))
    u, v = f.u * F.cos(t) + f.v * F.sin(t), f.v * F.cos(t) - f.u * F.sin(t)
    tan = F.abs(F.try_divide(v, u))
    low = F.exp(-F.pow(f.r / F.lit(float(cutoff)), 2)) if cutoff else F.lit(1.0)
    stripe = F.coalesce(F.when(tan <= 1, F.lit(1.0)).otherwise(1 - F.exp(-F.try_divide(f.r * f.r, F.pow(tan, F.lit(float(power)))))), F.lit(0.0))
    return _back(df, times(fft2(df, taper), low * stripe), True)


def spectrum(df: DataFrame, kind: str = "magnitude", taper: float = 0.0) -> DataFrame:
    """(survey_id, ky, kx, s): magnitude |F|/N, log (its log10), power |F|^2/N, phase, real or imaginary part."""
    n = F.col("nx") * F.col("ny")
    mag = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)
    s = {"magnitude": mag / n, "log": F.log10(F.when(mag > 0, mag / n)), "power": mag * mag / n, "phase": F.atan2("im", "re"), "real": F.col("re"), "imaginary": F.col("im")}[kind]
    return fft2(df, taper).select("survey_id", "ky", "kx", s.alias("s"))


def euler(df: DataFrame, index: float, window: int = 10, dx: float = 1.0, dy: float = 1.0, x_min: float = 0.0, y_min: float = 0.0, taper: float = 0.0) -> DataFrame:
    """(survey_id, iy, ix, x0, y0, depth, background, error) of sources by least squares in a window per cell.

    The normal equations' sums over [c - h, c + h) are window sums along both axes; each cell solves 4 equations.
    """
    from pyspark.sql import Window

    h = window // 2
    d = df.join(derivatives(df, dx, dy, taper), CELL)
    x, y = F.lit(float(x_min)) + F.col("ix") * F.lit(float(dx)), F.lit(float(y_min)) + F.col("iy") * F.lit(float(dy))
    d = d.withColumns({"a0": F.col("tx"), "a1": F.col("ty"), "a2": F.col("tz"), "a3": F.lit(float(index)), "b": x * F.col("tx") + y * F.col("ty") + F.lit(float(index)) * F.col("z"), "one": F.lit(1.0)})
    terms = {f"m{i}{j}": F.col(f"a{i}") * F.col(f"a{j}") for i in range(4) for j in range(i, 4)} | {f"r{i}": F.col(f"a{i}") * F.col("b") for i in range(4)} | {"bb": F.col("b") * F.col("b"), "n": F.col("one")}
    d = d.select(*CELL, *[v.alias(k) for k, v in terms.items()])
    wy = Window.partitionBy("survey_id", "ix").orderBy("iy").rangeBetween(-h, h - 1)
    wx = Window.partitionBy("survey_id", "iy").orderBy("ix").rangeBetween(-h, h - 1)
    d = d.select(*CELL, *[F.sum(k).over(wy).alias(k) for k in terms])
    d = d.select(*CELL, *[F.sum(k).over(wx).alias(k) for k in terms]).where(F.col("n") == 4 * h * h)
    names = list(terms)

    @F.pandas_udf("struct<x0:double,y0:double,depth:double,background:double,error:double>")
    def solve(s: pd.DataFrame) -> pd.DataFrame:
        n = len(s)
        m = np.zeros((n, 4, 4))
        for i in range(4):
            for j in range(i, 4):
                m[:, i, j] = m[:, j, i] = s[f"m{i}{j}"]
        r = np.stack([s[f"r{i}"] for i in range(4)], 1)
        out = np.full((n, 5), np.nan)
        good = np.linalg.cond(m) < 1e12
        if good.any():
            inv = np.linalg.inv(m[good])
            p = np.einsum("nij,nj->ni", inv, r[good])
            sse = np.maximum(s["bb"].to_numpy()[good] - np.einsum("ni,ni->n", p, r[good]), 0)
            cov = inv[:, 2, 2] * sse / np.maximum(s["n"].to_numpy()[good] - 4, 1)
            out[good] = np.stack((p[:, 0], p[:, 1], -p[:, 2], p[:, 3], np.sqrt(np.maximum(cov, 0))), 1)
        return pd.DataFrame(out, columns=["x0", "y0", "depth", "background", "error"]).astype(object).where(~np.isnan(out), None)

    return d.select(*CELL, solve(F.struct(*names)).alias("s")).select(*CELL, "s.*").where("x0 is not null")
