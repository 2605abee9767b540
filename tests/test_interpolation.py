"""Parallel triangulation, C1 cubics on it, and kriging in neighbourhoods, against whole-survey versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.operators import interpolation as I
from tellurion.operators import kriging as K
from tellurion.operators import triangulation as T
from tellurion.operators.joins import triangulate

POINTS = "survey_id string, pid bigint, track int, x double, y double, value double"
INFO = "survey_id string, nx int, ny int, x_min double, x_max double, y_min double, y_max double"


def clouds():
    rng = np.random.default_rng(0)
    return {
        "uniform": rng.random((700, 2)) * [100, 60], "lattice": np.array([(i * 2.0, j * 1.0) for i in range(22) for j in range(22)]),
        "clusters": np.concatenate([rng.normal(c, s, (120, 2)) for c, s in (((0, 0), 0.1), ((50, 50), 3), ((0, 80), 20), ((90, 0), 1), ((40, 10), 30))]),
        "tracks": np.array([(t * 5 + rng.normal(0, 0.05), k * 0.2) for t in range(6) for k in range(80)]), "ring": np.array([(np.cos(a), np.sin(a)) for a in rng.random(150) * 6.28]),
        "line": np.array([(i * 1.0, i * 2.0) for i in range(30)]), "two": np.array([(0.0, 0.0), (1.0, 1.0)]), "three": np.array([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0)]),
    }


def survey(spark, of, value=lambda x, y: x - y):
    """Every cloud as a survey; each first place twice, and one reading without a value."""
    rows = [(n, i, 0, float(x), float(y), float(value(x, y))) for n, xy in of.items() for i, (x, y) in enumerate([*xy, xy[0]])]
    return spark.createDataFrame([*rows, ("uniform", 9999, 0, 50.0, 30.0, None)], POINTS)


def test_triangles_are_those_of_one_triangulation(spark):
    """Cells of 60 points at most, over several rounds, on lattices (where circles tie), clusters, tracks and rims."""
    pts, tri = T.delaunay(survey(spark, clouds()), 60)
    place, got = {}, {}
    for r in pts.collect():
        place.setdefault(r["survey_id"], {})[r["id"]] = r
    for r in tri.collect():
        got.setdefault(r["survey_id"], []).append(tuple(sorted((r["a"], r["b"], r["c"]))))
    for n in clouds():
        p = list(place[n].values())
        whole = triangulate(np.array([r["u"] for r in p]), np.array([r["w"] for r in p]))
        want = sorted(tuple(sorted(p[i]["id"] for i in t)) for t in whole)
        assert sorted(got.get(n, [])) == want, n
    assert len(got["uniform"]) > 1300 and "two" not in got


def test_no_cell_takes_all_points(spark, monkeypatch):
    seen = []
    real = T._cells
    monkeypatch.setattr(T, "_cells", lambda p, most: (seen.append(real(p, most).groupBy("depth", "cx", "cy").count().agg(F.max("count")).first()[0]), real(p, most))[1])
    T.delaunay(survey(spark, {"uniform": clouds()["uniform"]}), 60)
    assert len(seen) > 2 and seen[0] <= 60 and max(seen) < 700 / 3


def test_linear_on_a_rough_surface(spark):
    """Node by node against the triangles of one triangulation."""
    rough = lambda x, y: np.sin(x) * 7 + np.cos(y * 1.3) * x
    xy = clouds()["uniform"][:200] / 10
    p = survey(spark, {"uniform": xy}, rough)
    info = spark.createDataFrame([("uniform", 21, 13, 0.0, 10.0, 0.0, 6.0)], INFO)
    got = {(r["iy"], r["ix"]): r["z"] for r in I.linear(p, info, most=40).collect()}
    tri = triangulate(xy[:, 0], xy[:, 1])
    v = rough(xy[:, 0], xy[:, 1])
    inside = 0
    for (iy, ix), z in got.items():
        fits = [w @ v[t] for t in tri if ((w := np.linalg.solve(np.vstack((xy[t].T, np.ones(3))), [ix * 0.5, iy * 0.5, 1])) >= -1e-9).all()]
        assert (z is None and not fits) or any(abs(f - z) < 1e-6 for f in fits), (iy, ix)
        inside += bool(fits)
    assert len(got) == 273 and 150 < inside < 273


def test_gradients_solve_the_whole_system(spark):
    """The iterated gradients are those of the dense linear system over all edges."""
    xy = clouds()["uniform"][:80]
    p = survey(spark, {"uniform": xy}, lambda x, y: np.sin(x / 20) * 10 + y * y / 50)
    pts, tri = T.delaunay(p, 30)
    rows = {r["id"]: r for r in T.gradients(pts, tri, 1e-10, steps=6).collect()}
    at = {k: i for i, k in enumerate(rows)}
    edges = {tuple(sorted(e)) for t in tri.collect() for e in ((t["a"], t["b"]), (t["b"], t["c"]), (t["c"], t["a"]))}
    m, b = np.zeros((2 * len(at), 2 * len(at))), np.zeros(2 * len(at))
    for i, j in edges:
        d = np.array([rows[j]["x"] - rows[i]["x"], rows[j]["y"] - rows[i]["y"]])
        n = np.hypot(*d)
        e, dv = d / n, rows[j]["v"] - rows[i]["v"]
        for p_, q in ((i, j), (j, i)):
            s, r = slice(2 * at[p_], 2 * at[p_] + 2), slice(2 * at[q], 2 * at[q] + 2)
            m[s, s] += 8 / n * np.outer(e, e)
            m[s, r] += 4 / n * np.outer(e, e)
            b[s] += 12 * dv / n**2 * e
    g = np.linalg.solve(m, b)
    assert np.allclose(g, np.array([[r["gx"], r["gy"]] for r in rows.values()]).ravel(), rtol=1e-6, atol=1e-7)


def test_clough_tocher_is_smooth_and_exact_on_quadratics():
    f = lambda x, y: 3 - x + 2 * y + x * x - 0.5 * x * y + 0.25 * y * y
    g = lambda x, y: (-1 + 2 * x - 0.5 * y, 2 - 0.5 * x + 0.5 * y)
    rng = np.random.default_rng(2)
    x, y = np.array([[0.0, 2.0, 0.5]] * 400), np.array([[0.0, 0.3, 1.7]] * 400)
    w = rng.dirichlet([1, 1, 1], 400)
    gx, gy = g(x, y)
    assert np.allclose(T.clough_tocher(x, y, f(x, y), gx, gy, w), f((x * w).sum(1), (y * w).sum(1)))
    # any values and gradients: value and slope across each inner edge and the shared outer edge of two triangles agree from both sides
    v, gx, gy = rng.normal(size=4), rng.normal(size=4), rng.normal(size=4)
    px, py = np.array([0.0, 2.0, 0.5, 1.9]), np.array([0.0, 0.3, 1.7, 2.2])

    def at(t, qx, qy):
        m = np.vstack((px[t], py[t], np.ones(3)))
        lam = np.linalg.solve(m, np.array([qx, qy, 1.0]))
        one = lambda a: a[t][None, :]
        return T.clough_tocher(one(px), one(py), one(v), one(gx), one(gy), lam[None, :])[0]

    def slopes(t, place, direction, h=1e-5):
        return (at(t, *(place + h * direction)) - at(t, *place)) / h

    left, right = np.array([0, 1, 2]), np.array([1, 2, 3])
    edge = np.array([px[2] - px[1], py[2] - py[1]])
    across = np.array([edge[1], -edge[0]]) / np.hypot(*edge)
    for s in (0.1, 0.37, 0.5, 0.9):
        q = np.array([px[1], py[1]]) + s * edge
        assert abs(at(left, *q) - at(right, *q)) < 1e-9
        assert abs(slopes(left, q, -across) + slopes(right, q, across)) < 1e-3
    centre = np.array([px[left].mean(), py[left].mean()])
    for k in left:
        spoke = np.array([px[k], py[k]]) - centre
        side = np.array([spoke[1], -spoke[0]]) / np.hypot(*spoke)
        q = centre + 0.4 * spoke
        assert abs(slopes(left, q, side) + slopes(left, q, -side)) < 1e-3


def test_cubic_beats_linear_and_fits_polynomials(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.random((300, 2)) * 10, [[0, 0], [0, 10], [10, 0], [10, 10]]])
    surfaces = {"rough": lambda x, y: np.sin(x) * np.cos(0.7 * y) + 0.3 * x, "plane": lambda x, y: 2 * x - y + 1, "cube": lambda x, y: 0.1 * x**3 - 0.2 * x * x * y + y * y}
    p = spark.createDataFrame([(n, i, 0, float(x), float(y), float(f(x, y))) for n, f in surfaces.items() for i, (x, y) in enumerate(xy)], POINTS)
    info = spark.createDataFrame([(n, 21, 21, 0.0, 10.0, 0.0, 10.0) for n in surfaces], INFO)
    worst = {}
    for how in (I.linear, I.cubic):
        for r in how(p, info, most=150).where("ix BETWEEN 4 AND 16 AND iy BETWEEN 4 AND 16").collect():
            k = (how.__name__, r["survey_id"])
            worst.setdefault(k, []).append(abs(r["z"] - surfaces[r["survey_id"]](r["ix"] * 0.5, r["iy"] * 0.5)))
    mean = {k: np.mean(v) for k, v in worst.items()}
    assert mean["cubic", "plane"] < 1e-6 and mean["cubic", "rough"] < mean["linear", "rough"] / 3 and mean["cubic", "cube"] < mean["linear", "cube"] / 3 and mean["cubic", "cube"] < 0.05


def test_nodes_on_points_and_empty_surveys(spark):
    p = survey(spark, {"lattice": clouds()["lattice"]}, lambda x, y: np.sin(3 * x) + y * y)
    info = spark.createDataFrame([("lattice", 22, 22, 0.0, 42.0, 0.0, 21.0), ("none", 2, 2, 0.0, 1.0, 0.0, 1.0)], INFO)
    for how in (I.linear, I.cubic):
        rows = how(p, info, most=100).collect()
        assert len(rows) == 22 * 22 + 4 and all(r["z"] is None for r in rows if r["survey_id"] == "none")
        assert all(abs(r["z"] - (np.sin(6 * r["ix"]) + r["iy"] ** 2)) < 1e-9 for r in rows if r["survey_id"] == "lattice")
        assert all(r["z"] is None for r in how(p.limit(0), info).collect())


# kriging ---------------------------------------------------------------------------------

MODEL = {"kind": "spherical", "nugget": 0.1, "sill": 2.0, "range": 30.0}


def spherical():
    shape = I.MODELS["spherical"]
    return lambda h: np.where(h > 0, 0.1 + 2.0 * shape(h, 30.0), 0.0)


@pytest.mark.parametrize("crowd", [20, 4000])
def test_nearest_places_are_the_nearest(spark, monkeypatch, crowd):
    """Uniform, clustered and lattice surveys; with a low limit all nodes are searched for one by one."""
    monkeypatch.setattr(K, "CROWD", crowd)
    of = {n: clouds()[n] for n in ("uniform", "clusters", "lattice", "two")}
    info = spark.createDataFrame([(n, 13, 11, -10.0, 110.0, -20.0, 90.0) for n in of], INFO)
    got = {(r["survey_id"], r["iy"], r["ix"]): (r["farthest"], r["used"]) for r in K.krige_near(survey(spark, of), info, spherical(), 7).collect()}
    assert len(got) == 13 * 11 * len(of)
    for n, xy in of.items():
        u = np.unique(xy, axis=0)
        m = min(7, len(u))
        for iy in range(11):
            for ix in range(13):
                d = np.sort(np.hypot(u[:, 0] + 10 - ix * 10, u[:, 1] + 20 - iy * 11))
                assert got[n, iy, ix] == (pytest.approx(d[m - 1]), m), (n, iy, ix)


def test_local_kriging_is_dense_kriging_where_it_takes_all(spark):
    p = survey(spark, {"clusters": clouds()["clusters"][::6]}, lambda x, y: np.sin(x / 15) + y / 40)
    info = spark.createDataFrame([("clusters", 9, 8, -5.0, 95.0, -5.0, 90.0)], INFO)
    dense = {(r["iy"], r["ix"]): (r["z"], r["stdev"]) for r in I.krige(p, info, MODEL).collect()}
    near = {(r["iy"], r["ix"]): (r["z"], r["stdev"]) for r in I.krige(p, info, MODEL, limit=10, near=500).collect()}
    assert len(dense) == 72 and all(near[k] == pytest.approx(v, rel=1e-6, abs=1e-6) for k, v in dense.items())


def test_kriging_of_small_and_large_surveys_together(spark):
    of = {"three": clouds()["three"], "uniform": clouds()["uniform"]}
    info = spark.createDataFrame([("three", 3, 3, 0.0, 1.0, 0.0, 1.0), ("uniform", 6, 5, 0.0, 100.0, 0.0, 60.0), ("none", 2, 1, 0.0, 1.0, 0.0, 0.0)], INFO)
    got = I.krige(survey(spark, of), info, MODEL, limit=100, near=16).collect()
    assert {n: sum(r["survey_id"] == n for r in got) for n in ("three", "uniform", "none")} == {"three": 9, "uniform": 30, "none": 2}
    assert all(np.isfinite(r["z"]) for r in got if r["survey_id"] != "none")


def test_bilinear_takes_points_as_they_are(spark):
    """Equal pids, places outside and meshes without a corner; points are neither sorted by survey nor joined with themselves."""
    info = spark.createDataFrame([("s", 4, 3, 0.0, 6.0, 0.0, 2.0)], INFO)
    grid = spark.createDataFrame([("s", y, x, None if (y, x) == (2, 3) else 2.0 * x * 2 - y + x * y) for y in range(3) for x in range(4)], "survey_id string, iy int, ix int, z double")
    places = [(7, 1.0, 0.5), (7, 3.0, 1.25), (7, 0.0, 2.0), (8, 5.0, 1.5), (9, 6.5, 1.0), (9, None, 1.0), (None, 6.0, 0.0)]
    pts = spark.createDataFrame([("s", i, 0, x, y, 0.0) for i, x, y in places] + [("t", 1, 0, 1.0, 1.0, 0.0)], POINTS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = I.sample(pts, grid, info)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r["survey_id"], r["x"], r["y"]): r["sampled"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    surface = lambda x, y: 2.0 * x - y + x / 2 * y
    for _, x, y in places[:3] + places[6:]:
        assert got["s", x, y] == pytest.approx(surface(x, y))
    assert len(got) == 8 and all(got[k] is None for k in (("s", 5.0, 1.5), ("s", 6.5, 1.0), ("s", None, 1.0), ("t", 1.0, 1.0)))
    assert "SortMergeJoin" not in plan and out.columns == [*pts.columns, "sampled"]
