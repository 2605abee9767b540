import numpy as np
import pytest

from tellurion.operators import interpolation as I

INFO = "survey_id string, nx int, ny int, x_min double, x_max double, y_min double, y_max double"


def surface(x, y):
    return 1 + 2 * x - y + 0.5 * x * x - 0.25 * y * y + 0.3 * x * y


def grid(spark, nx=7, ny=6, hole=None):
    rows = [("a", j, i, None if (j, i) == hole else float(surface(i * 0.5, j * 2.0))) for j in range(ny) for i in range(nx)]
    return spark.createDataFrame(rows, "survey_id string, iy int, ix int, z double"), spark.createDataFrame([("a", nx, ny, 0.0, (nx - 1) * 0.5, 0.0, (ny - 1) * 2.0)], INFO)


def test_parabolas_are_met_up_to_the_rims(spark):
    g, info = grid(spark)
    rng = np.random.default_rng(1)
    at = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(0, 3, 60), rng.uniform(0, 10, 60), strict=True))] + [(90, 0.0, 0.0), (91, 3.0, 10.0), (92, 3.1, 1.0), (93, None, 1.0)]
    points = spark.createDataFrame([("a", *p) for p in at], "survey_id string, pid int, x double, y double")
    got = {r["pid"]: r["sampled"] for r in I.sample_cubic(points, g, info).collect()}
    assert len(got) == 64 and got[92] is None and got[93] is None
    assert all(np.isclose(got[k], surface(x, y)) for k, x, y in at if k < 92)


def test_smooth_between_nodes(spark):
    """C1: differences from both sides of a node agree on a rough surface."""
    g = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate([0, 5, -3, 8, 1, 1, 9])], "survey_id string, iy int, ix int, z double")
    info = spark.createDataFrame([("a", 7, 1, 0.0, 6.0, 0.0, 0.0)], INFO)
    h = 1e-5
    points = spark.createDataFrame([("a", 3 * k + j, k + d * h, 0.0) for k in range(1, 6) for j, d in enumerate((-1, 0, 1))], "survey_id string, pid int, x double, y double")
    got = {r["pid"]: r["sampled"] for r in I.sample_cubic(points, g, info).collect()}
    assert all(abs((got[3 * k + 2] - got[3 * k + 1]) - (got[3 * k + 1] - got[3 * k])) < 1e-7 for k in range(1, 6))


@pytest.mark.parametrize(("nx", "ny"), [(7, 6), (3, 3)])
def test_regrid(spark, nx, ny):
    g, info = grid(spark, nx, ny)
    fresh = spark.createDataFrame([("a", 5, 9, 0.25, 1.0, 0.5, 4.0)], INFO)
    got = {(r["iy"], r["ix"]): r["z"] for r in I.regrid(g, info, fresh).collect()}
    assert len(got) == 45 and all(np.isclose(z, surface(0.25 + i * 0.75 / 4, 0.5 + j * 3.5 / 8)) for (j, i), z in got.items())


def test_holes_and_outside(spark):
    g, info = grid(spark, hole=(2, 3))
    same = {(r["iy"], r["ix"]) for r in I.regrid(g, info, info).collect()}
    assert len(same) == 41 and (2, 3) not in same  # nodes themselves are met whatever lies beside them
    wide = spark.createDataFrame([("a", 3, 1, -1.0, 1.0, 0.0, 0.0)], INFO)
    assert {(r["iy"], r["ix"]) for r in I.regrid(g, info, wide).collect()} == {(0, 1), (0, 2)}
    assert I.regrid(g.limit(0), info, info).count() == 0
