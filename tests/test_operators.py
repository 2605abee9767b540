"""Known answers, closed forms and edge cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.functions import geodesy
from tellurion.model import STEPS, Survey
from tellurion.operators import correlation as C
from tellurion.operators import emi as M
from tellurion.operators import grids as G
from tellurion.operators import interpolation as I
from tellurion.operators import joins as J
from tellurion.operators import points as P
from tellurion.operators import spectral as S
from tellurion.operators import tracks as T


def points(spark, rows):
    """rows: (track, x, y, value)"""
    data = [("s", i, t, float(x), float(y), None if v is None else float(v)) for i, (t, x, y, v) in enumerate(rows)]
    return spark.createDataFrame(data, "survey_id string, pid bigint, track int, x double, y double, value double")


def series(spark, values):
    return points(spark, [(0, i, 0, v) for i, v in enumerate(values)])


def grid(spark, z):
    rows = [("s", i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(np.asarray(z, float))]
    return spark.createDataFrame(rows, "survey_id string, iy int, ix int, z double")


def values(df, col="value"):
    return [r[col] for r in df.orderBy("pid").select(col).collect()]


def array(df, col="z"):
    rows = df.select("iy", "ix", col).collect()
    out = np.full((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1), np.nan)
    for y, x, v in rows:
        out[y, x] = np.nan if v is None else v
    return out


def test_hampel(spark):
    got = values(T.hampel(series(spark, [1, 2, 50, 3, 2, None, 4, -40, 5, 4]), 5, 3.0))
    assert got == [1, 2, 2, 3, 2, None, 4, 4, 5, 4]


def test_constant_series_stay(spark):
    p = series(spark, [7] * 9)
    assert values(T.hampel(p)) == values(T.median_decision(p)) == [7] * 9
    g = grid(spark, np.full((4, 5), 7.0))
    assert (array(G.median_filter(g, (3, 3))) == 7).all() and (array(G.hampel_filter(g)) == 7).all()


def test_levels_and_zero(spark):
    p = points(spark, [(1, i, 0, v) for i, v in enumerate((1, 2, 3))] + [(2, i, 1, v) for i, v in enumerate((11, 12, 13))])
    assert values(T.level(p)) == [6, 7, 8, 6, 7, 8]
    assert values(T.zero_tracks(p)) == [-1, 0, 1, -1, 0, 1]
    flat = points(spark, [(1, 0, 0, 5), (1, 1, 0, 5), (2, 0, 0, 1), (2, 1, 0, 3)])
    assert values(T.level(flat, "mean", "multi"))[:2] == [3.5, 3.5]


def test_median_step(spark):
    p = points(spark, [(0, x, 0, 1) for x in (0, 0.5, 0.5, 1, 2)])
    assert P.median_step(p).first()["step"] == 0.5
    assert P.median_step(p, "y").first()["step"] == 0.0


@pytest.mark.parametrize("fill, want", [("clip", [0, 1, 3, 5]), ("mean", [2, 1, 3, 2]), ("median", [2, 1, 3, 2]), ("null", [None, 1, 3, None]), (9.5, [9.5, 1, 3, 9.5])])
def test_threshold(spark, fill, want):
    p = series(spark, [-5, 1, 3, 9])
    assert values(P.threshold(p, 0, 5, fill)) == want
    assert tuple(P.threshold_stats(p, 0, 5).first())[1:] == (2, 50.0)


def test_threshold_is_idempotent_and_add_subtract_is_identity(spark):
    p = series(spark, [-5, 1, None, 9])
    once = P.threshold(p, 0, 5)
    assert values(P.threshold(once, 0, 5)) == values(once)
    assert values(P.subtract(P.add(p, 3), 3)) == values(p)
    assert values(P.divide(p, 0)) == [None] * 4


def test_rotate_grid(spark):
    g = grid(spark, [[1, 2, 3], [4, 5, 6]])
    assert array(G.rotate(g, 90)).tolist() == [[3, 6], [2, 5], [1, 4]]
    four = g
    for _ in range(4):
        four = G.rotate(four, 90)
    assert array(four).tolist() == array(g).tolist()
    assert array(G.rotate(g, 180)).tolist() == np.rot90([[1, 2, 3], [4, 5, 6]], 2).tolist()
    with pytest.raises(ValueError):
        G.rotate(g, 45)


def mirrored(z, size):
    """Windows of a grid with mirrored rims, by numpy alone."""
    (h, w), (a, b) = z.shape, size
    p = np.pad(z, ((a // 2, a - 1 - a // 2), (b // 2, b - 1 - b // 2)), mode="symmetric")
    return np.lib.stride_tricks.sliding_window_view(p, size).reshape(h, w, -1)


def test_neighbourhoods_against_numpy(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(7, 9))
    g = grid(spark, z)
    for size in ((3, 3), (5, 5), (3, 5), (2, 2)):
        win = mirrored(z, size)
        assert np.allclose(array(G.separate_trends(g, size, "regional")), win.mean(2))
        want = np.sort(win, 2)[:, :, win.shape[2] // 2]
        assert np.allclose(array(G.median_filter(g, size)), want)
    win = mirrored(z, (5, 5))
    sd = win.std(2)
    want = 2 / np.maximum(sd, sd.max() * 0.1) * (z - win.mean(2)) + 1
    assert np.allclose(array(G.wallis(g, 5, 1.0, 2.0)), want)


def test_clahe_keeps_range(spark):
    z = np.random.default_rng(0).normal(size=(16, 16))
    out = array(G.clahe(grid(spark, z), (8, 8), 0.05))
    assert out.min() >= z.min() - 1e-9 and out.max() <= z.max() + 1e-9 and not np.isnan(out).any()
    assert np.isnan(array(G.clahe(grid(spark, [[1.0, np.nan], [2.0, 3.0]]), (2, 2)))[0, 1])


def plain_clahe(z, ky, kx, clip, bins):
    """Cell by cell; as in the SQL, cells without a value count in the last bin."""
    ny, nx = z.shape
    lo, hi = np.nanmin(z), np.nanmax(z)
    b = np.where(np.isnan(z), bins - 1, np.minimum(np.floor((np.nan_to_num(z) - lo) / (hi - lo) * bins), bins - 1)).astype(int)
    out = np.full(z.shape, np.nan)
    for (i, j), v in np.ndenumerate(z):
        fy, fx = (i - (ky - 1) / 2) / ky, (j - (kx - 1) / 2) / kx
        mixed = 0.0
        for dy in (0, 1):
            for dx in (0, 1):
                ty, tx = min(max(int(np.floor(fy)) + dy, 0), (ny - 1) // ky), min(max(int(np.floor(fx)) + dx, 0), (nx - 1) // kx)
                c = np.bincount(b[ty * ky : (ty + 1) * ky, tx * kx : (tx + 1) * kx].ravel(), minlength=bins)
                cut = np.minimum(c, max(1.0, clip * c.sum()))
                share = (cut[: b[i, j] + 1].sum() + (c.sum() - cut.sum()) * (b[i, j] + 1) / bins) / c.sum()
                mixed += (fy % 1 if dy else 1 - fy % 1) * (fx % 1 if dx else 1 - fx % 1) * share
        out[i, j] = v if np.isnan(v) else lo + mixed * (hi - lo)
    return out


@pytest.mark.parametrize(("kernel", "least"), [((4, 3), 1 << 16), ((4, 3), 1), ((1, 2), 1 << 16), ((40, 40), 1 << 16)])
def test_clahe_sends_each_cell_once(spark, monkeypatch, kernel, least):
    """Against a plain version, with a tile of no value; only one join sorts the cells, and their maps don't go on to further ones."""
    monkeypatch.setattr(G, "LEAST", least, raising=False)
    z = np.random.default_rng(1).gamma(1.0, size=(13, 11))
    z[4:8, 3:6], z[0, 0] = np.nan, np.nan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = G.clahe(grid(spark, z), kernel, 0.1, 16)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert np.allclose(array(out), plain_clahe(z, *kernel, 0.1, 16), equal_nan=True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.split("== Initial Plan ==")[-1].count("SortMergeJoin") == 1


def test_points_are_not_sent_by_survey(spark):
    """Cell means and descriptions of them bring the extents to the points."""
    p = points(spark, [(0, x, y, x * y) for x in range(6) for y in range(4)])
    info = G.grid_info(p, 1.0, 1.0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        binned = G.bin_points(p, info)
        plan = binned._jdf.queryExecution().executedPlan().toString()
        assert binned.count() == 15 and array(binned)[0, 0] == 0 and array(binned)[2, 4] == np.mean([8, 12, 10, 15])
        cut, ends = G.crop_extent(binned, info, xmin=1.0)
        sent = ends._jdf.queryExecution().executedPlan().toString()
        assert G.describe(cut, ends).first()["nrow"] == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "SortMergeJoin" not in sent


def test_polynomial_of_a_cubic_is_zero(spark):
    d = np.arange(12) * 0.5
    p = points(spark, [(t, x, 0, 1 + x - 2 * x**2 + x**3 + t) for t in (1, 2) for x in d])
    assert np.allclose(values(T.polynomial(p, 3)), 0, atol=1e-8)
    short = points(spark, [(1, 0, 0, 4), (1, 1, 0, 5)])
    assert values(T.polynomial(short, 3)) == [4, 5]
    g = grid(spark, np.arange(10)[:, None] * 2.0 + np.array([[1.0, 5.0]]))
    assert np.allclose(array(T.polynomial(g, 1, kind="grid")), 0, atol=1e-9)


def test_spectra_closed_forms(spark):
    n, m = 16, 12
    y, x = np.mgrid[0:m, 0:n]
    z = np.cos(2 * np.pi * 3 * x / n)
    g = grid(spark, z)
    k = 2 * np.pi * 3 / n
    assert np.allclose(array(S.continue_field(g, 0.7)), z * math.exp(-0.7 * k))
    assert np.allclose(array(S.continue_field(S.continue_field(g, 0.5), -0.5)), z)
    assert np.allclose(array(S.analytic_signal(g)), k)
    z2 = np.random.default_rng(1).normal(size=(m, n))
    spec = S.fft2(grid(spark, z2)).select("ky", "kx", "re", "im").collect()
    want = np.fft.fft2(z2 - z2.mean())
    assert all(np.isclose(r["re"] + 1j * r["im"], want[r["ky"], r["kx"]], atol=1e-9) for r in spec)
    z3 = np.random.default_rng(3).normal(size=(11, 15))  # odd sizes: an even one's highest term has no sign, so phases there can't be undone
    back = array(S.convert_sensor(S.convert_sensor(grid(spark, z3), "TotalField", "Fluxgate"), "Fluxgate", "TotalField"))
    assert np.allclose(back, z3 - z3.mean(), atol=1e-6)
    assert np.allclose(array(S.unpad(S.pad_cosine(g, 3), 3)), z)
    holes = z2.copy()
    holes[2, 3] = np.nan
    assert np.isnan(array(S.continue_field(grid(spark, holes), 1.0))[2, 3])


def test_pole_reduction_of_a_vertical_field_changes_nothing(spark):
    z = np.random.default_rng(2).normal(size=(8, 8))
    assert np.allclose(array(S.reduce_to_pole(grid(spark, z), 90.0, 0.0)), z - z.mean(), atol=1e-9)


def test_euler_finds_a_source(spark):
    n = 32
    y, x = np.mgrid[0:n, 0:n].astype(float)
    r2 = (x - 15) ** 2 + (y - 16) ** 2 + 4.0**2
    got = S.euler(grid(spark, 1e4 * 4.0 / r2**1.5), 2.0, 10).where("iy between 14 and 18 and ix between 13 and 17").agg(F.avg("x0").alias("x"), F.avg("y0").alias("y"), F.avg("depth").alias("d")).first()
    assert abs(got["x"] - 15) < 0.5 and abs(got["y"] - 16) < 0.5 and abs(abs(got["d"]) - 4) < 1.0


def test_plane_is_interpolated_exactly(spark):
    rng = np.random.default_rng(5)
    xy = np.vstack((rng.uniform(0, 10, (60, 2)), [[0, 0], [0, 10], [10, 0], [10, 10]]))
    p = points(spark, [(0, x, y, 2 * x + 3 * y) for x, y in xy])
    info = G.grid_info(p, 1.0, 1.0)
    node = G.lattice(info).select("iy", "ix", (2 * F.col("x") + 3 * F.col("y")).alias("z"))
    want = array(node)
    assert np.allclose(array(I.linear(p, info)), want)
    assert np.allclose(array(I.linear(p, info, most=12)), want)
    assert np.allclose(array(I.radial(p, info, "thin_plate_spline")), want, atol=1e-6)
    sampled = I.sample(p, node.withColumn("survey_id", F.lit("s")), info)
    assert all(np.isclose(r["sampled"], r["value"]) for r in sampled.collect())
    with pytest.raises(Exception, match="dense solve"):
        I.radial(p, info, limit=10).count()


def test_kriging_honours_points_and_variogram_fit(spark):
    rng = np.random.default_rng(6)
    p = points(spark, [(0, x, y, math.sin(x / 3) + y / 10) for x in range(6) for y in range(6)])
    table = I.variogram(p, 1.0, 6).orderBy("lag").toPandas()
    model = I.fit_variogram(table, "gaussian")
    assert model["sill"] > 0 and model["range"] > 0
    info = G.grid_info(p, 1.0, 1.0)
    model["nugget"] = 0.0
    out = I.krige(p, info, model)
    got, sd = array(out), array(out, "stdev")
    want = np.array([[math.sin(x / 3) + y / 10 for x in range(6)] for y in range(6)])
    assert np.allclose(got, want, atol=1e-4) and (sd < 1e-2).all()
    del rng


def test_recipe_replays(spark, tmp_path):
    s = Survey("s", points=series(spark, [1, 2, 30, 4])).apply("add_to_points", value=1.0).apply("threshold_points", vmin=0.0, vmax=10.0).apply("zero_mean_tracks")
    s.export_history(str(tmp_path / "r.json"))
    steps = json.loads((tmp_path / "r.json").read_text())
    assert [e["step"] for e in steps] == ["add_to_points", "threshold_points", "zero_mean_tracks"]
    again = Survey("s", points=series(spark, [1, 2, 30, 4])).replay((tmp_path / "r.json").read_text())
    assert values(again.points) == values(s.points) and again.history == s.history
    with pytest.raises(ValueError, match="unknown step"):
        s.apply("no_such_step")
    with pytest.raises(ValueError, match="lacks"):
        s.apply("rotate_grid", angle=90)
    assert len(STEPS) > 30


def test_empty_single_and_null_inputs(spark):
    none = series(spark, [])
    for f in (P.stats, T.level, T.hampel, T.distance_along_track, T.polynomial, lambda d: P.threshold(d, 0, 1, "mean"), P.median_step):
        assert f(none).count() == 0
    one = points(spark, [(3, 5, 5, 2)])
    assert values(T.hampel(one)) == [2] and values(T.level(one)) == [2] and values(T.detrend_linear(one)) == [0]
    null = series(spark, [None, None])
    assert values(T.level(null)) == [None, None] and values(T.hampel(null)) == [None, None]


def test_fill_and_regression(spark):
    p = series(spark, [None, 1, None, 3, None])
    assert values(T.fill_linear(p, "value", "x", ["track"])) == [1, 1, 2, 3, 3]
    assert np.allclose(values(T.regress_fill(p, ["value"], ["track"])), [0, 1, 2, 3, 4])


def test_shift_finds_the_lag(spark):
    rng = np.random.default_rng(8)
    base = np.convolve(rng.normal(size=60), np.ones(5) / 5, "same")
    z = np.stack([base, np.roll(base, 3), base, np.roll(base, 3), base], 1)
    out = array(C.destagger(grid(spark, z), 6))
    assert np.allclose(out, base[:, None])
    assert C.best_shift(base, np.roll(base, 2))[0] == -2


def test_overlap_matches_the_full_comparison(spark):
    rng = np.random.default_rng(9)
    a, b = rng.uniform(-5, 5, (60, 2)), rng.uniform(-5, 5, (60, 2))
    got = {(r["id_a"], r["id_b"]) for r in J.overlap(points(spark, [(0, x, y, 1) for x, y in a]), points(spark, [(0, x, y, 1) for x, y in b]), 0.9).collect()}
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    assert got == set(zip(*map(lambda v: v.tolist(), np.nonzero(d <= 0.9)), strict=True))


def test_borders_bring_surveys_to_one_scale(spark):
    rows = [(0, x, y, 10 + x + y) for x in range(8) for y in range(8)]
    other = [(0, x + 7.2, y, 2 * (10 + x + 7 + y) + 5) for x in range(8) for y in range(8)]
    out = J.join_borders({1: points(spark, rows), 2: points(spark, other)}, 0.5)
    assert np.allclose([r["value"] for r in out[2].where("x < 7.5").orderBy("pid").collect()], [17 + y for y in range(8)], atol=0.05)


def test_georeference(spark):
    c = [(0.0, 0.0, 100.0, 200.0), (10.0, 0.0, 110.0, 200.0), (0.0, 10.0, 100.0, 210.0), (10.0, 10.0, 110.0, 210.0)]
    r = J.georeference(points(spark, [(0, 3, 4, 1), (0, 30, 4, 1)]), c).orderBy("pid").collect()
    assert np.allclose((r[0]["east"], r[0]["north"]), (103, 204)) and r[1]["east"] is None
    with pytest.raises(ValueError):
        J.georeference(points(spark, []), c[:3])


def test_utm(spark):
    e, n, z = geodesy.utm(F.lit(0.0), F.lit(3.0))
    r = spark.range(1).select(e.alias("e"), n.alias("n"), z.alias("z")).first()
    assert abs(r["e"] - 500000) < 1e-6 and abs(r["n"]) < 1e-6 and r["z"] == 31
    e, n, z = geodesy.utm(F.lit(48.8583), F.lit(2.2945))
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(r["e"] - 448252) < 2 and abs(r["n"] - 5411943) < 2


def test_emi(spark):
    assert M.channel_offset([1.0, 2.0, 4.0], 0.5, 0) == 0.5 - (1.0 - 4.0) / 2
    x = np.linspace(0.1, 3, 40)
    assert np.allclose(M.fit_relation(x, 2 + 3 * x), [2, 3])
    y = 1 + x - 0.5 * x**2 + 0.2 * x**3
    y[5] += 100
    assert np.allclose(M.fit_relation(x, y, "poly_3"), [1, 1, -0.5, 0.2], atol=0.05)
    d = M.device(1, "d", "HCP", False, (0, 0), [3.0], [4.0], 0.1, [30000.0])
    assert d["tr"] == [5.0]
    devices = M.add_device(spark.createDataFrame([], M.DEVICES), d)
    assert devices.count() == 1 and M.remove_device(devices, 1).count() == 0
    with pytest.raises(ValueError):
        M.device(1, "d", "XX", False, (0, 0), [1.0], [1.0], 0.1, [1.0])


def test_pseudo_profiles(spark):
    xs = np.concatenate([np.linspace(-10, 10, 21), np.linspace(10, -10, 21), np.linspace(-10, 10, 21)])
    rows = [("f", i, float(x), float(np.sign(1) * 0.0 + (i // 21) * 5 + 0.0)) for i, x in enumerate(xs)]
    df = spark.createDataFrame([(a, b, y, x) for a, b, x, y in rows], "file_id string, pid bigint, x double, y double")
    got = M.pseudo_profiles(df, tn=3, factor=20.0).groupBy("profile").count().orderBy("profile").collect()
    assert len(got) == 3 and sum(r["count"] for r in got) == 63


def test_drift_correction(spark):
    p = spark.createDataFrame([(1, i, float(t), v) for i, (t, v) in enumerate([(1, 11.0), (5, 15.0), (9, 19.0)])], "file_id int, pid bigint, seconds double, value double")
    b = spark.createDataFrame([(1, 0.0, 10.0), (1, 10.0, 20.0)], "file_id int, seconds double, value double")
    assert values(J.correct_drift(p, b, ["file_id"])) == [10, 10, 10]


def test_along_paths(spark):
    p = points(spark, [(1, x, 0, 0) for x in range(5)])
    assert values(T.shift_along_trajectory(p, 1.5), "x") == [1.5, 2.5, 3.5, 4.5, 5.5]
    assert values(T.offset_along_track(p, 1.0, 2.0), "y") == [2.0] * 5
    assert values(T.distance_along_track(p), "distance") == [0, 1, 2, 3, 4]


def test_streaming(spark, tmp_path):
    from tellurion.streaming import tracks as ST

    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id*10,0) as ts, cast(1 as int) as track, cast(id as double) as value from range(6)").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, track int, value double").parquet(src)
    out = ST.window_stats(ST.apply_stateless(stream, "add_to_points", value=1.0), "30 minutes")
    q = out.writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(r["mean"] for r in spark.table("stats").collect()) == [2.0, 5.0]
    with pytest.raises(ValueError):
        ST.apply_stateless(stream, "zero_mean_tracks")


def test_linear_sparse_survey_is_the_whole_triangulation(spark):
    """Gaps far wider than a tile's halo: every node as in one triangulation of all points."""
    from tellurion.operators.joins import triangulate

    rng = np.random.default_rng(8)
    x, y = np.concatenate((rng.uniform(0, 1, 12), rng.uniform(38, 40, 12), [0, 40, 0, 40])), np.concatenate((rng.uniform(0, 40, 24), [0, 0, 40, 40]))
    v = np.sin(x) * 10 + y**2
    p = spark.createDataFrame([("s", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, v, strict=True))], "survey_id string, pid bigint, x double, y double, value double")
    got = {(r["iy"], r["ix"]): r["z"] for r in I.linear(p, G.grid_info(p, 1.0, 1.0), most=8).collect()}
    assert len(got) == 41 * 41 and None not in got.values()
    tri = triangulate(x, y)
    for (b, a), z in got.items():
        fits = []
        for t in tri:
            w = np.linalg.lstsq(np.array([x[t], y[t], np.ones(3)]), np.array([a, b, 1.0]), rcond=None)[0]
            if (w >= -1e-7).all():
                fits.append(w @ v[t])
        assert any(abs(f - z) < 1e-4 for f in fits), (a, b)
