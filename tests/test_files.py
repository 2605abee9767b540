"""Round trips of file formats."""

import numpy as np
import pytest

from tellurion.operators import grids as G
from tellurion.sources import files, sinks


def _survey(spark):
    z = np.array([[1.5, 2.25, np.nan], [4.0, -5.5, 6.0]])
    rows = [("g", i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(z)]
    grid = spark.createDataFrame(rows, "survey_id string, iy int, ix int, z double")
    info = spark.createDataFrame([("g", 3, 2, 10.0, 12.0, 5.0, 6.0)], "survey_id string, nx int, ny int, x_min double, x_max double, y_min double, y_max double")
    return grid, info


def _cells(df):
    return {(r["iy"], r["ix"]): r["z"] for r in df.collect()}


@pytest.mark.parametrize("fmt", [files.SURFER7, files.SURFER6, files.SURFER6_ASCII])
def test_surfer(spark, tmp_path, fmt):
    grid, info = _survey(spark)
    path = str(tmp_path / "g.grd")
    sinks.write_grid(grid, info, path, fmt)
    s = files.load_survey(spark, path)
    assert _cells(s.grid) == _cells(grid)
    assert tuple(s.grid_info.first())[1:] == (3, 2, 10.0, 12.0, 5.0, 6.0)


def test_surfer_rejects_junk():
    with pytest.raises(ValueError):
        files.parse_surfer(b"JUNK....")


def test_matrix(spark, tmp_path):
    grid, info = _survey(spark)
    sinks.write_matrix(grid, info, str(tmp_path / "m"))
    got = files.read_matrix(spark, str(tmp_path / "m"))
    assert _cells(got) == _cells(grid)
    assert {r["x"] for r in got.collect()} == {10.0, 11.0, 12.0}


def test_ascii(spark, tmp_path):
    f = tmp_path / "p.dat"
    f.write_text("# note\n1,2,x,0,5.5\n3,4,x,0,bad\nno,4,x,0,1\n\n")
    df = files.read_ascii(spark, str(f), column_map={"x": 0, "y": 1, "value": 4})
    assert [(r["x"], r["y"], r["value"]) for r in df.orderBy("pid").collect()] == [(1, 2, 5.5), (3, 4, None)]
    h = tmp_path / "h.csv"
    h.write_text("a;b;v\n1,5;2;3\n4;5;nan\n")
    df = files.read_ascii(spark, str(h), column_map={"x": "a", "y": "b", "value": "v"}, header=True)
    assert [(r["survey_id"], r["x"], r["value"]) for r in df.orderBy("pid").collect()] == [("h", 1.5, 3), ("h", 4, None)]
    sinks.write_points(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["x", "y", "value", "track"] and back.count() == 2
    with pytest.raises(ValueError):
        files.load_survey(spark, str(tmp_path / "x.unknown"))


def test_uxo(spark, tmp_path):
    p = spark.createDataFrame([("s", 0, 7, 1.25, 2.5, 100.5), ("s", 1, 7, 1.5, 2.75, None)], "survey_id string, pid bigint, track int, x double, y double, value double")
    sinks.write_uxo(p, str(tmp_path / "u"))
    got = files.read_uxo(spark, str(tmp_path / "u")).orderBy("pid").collect()
    assert [(r["x"], r["y"], r["value"], r["track"]) for r in got] == [(1.25, 2.5, 100.5, 7), (1.5, 2.75, None, 7)]


def test_uxo_as_instruments_write_it(spark, tmp_path):
    """Hand-written lines: decimal commas and ';', track-probe, missing local places, geographic and projected coordinates; two files of two separators."""
    a, b = tmp_path / "a.uxo", tmp_path / "b.uxo"
    a.write_text("[001]\tFile Format\tUXO100\n[041]\tColumn separator\ttab\n[072]\t1.5\t2.5\t0\t100.25\t00007\n[072]\t1.500\t2.500\t0.100\t-3.5\t00008-2\t3°30.00000000\t48°15.00000000\t35.000\t500100.5\t5300200.25\t36.000\n")
    b.write_text("[041];Column separator;;\n[072];1,5;2,5;0,0;100,25;00003\n[072];;;;7,5;00004;3°30,6;48°15,0;35,0\n")
    got = {(r["survey_id"], r["track"]): r for r in files.read_uxo(spark, [str(a), str(b)]).collect()}
    plain = got["a", 7]
    assert (plain["x"], plain["y"], plain["z"], plain["value"], plain["probe"], plain["lon"], plain["east"]) == (1.5, 2.5, 0, 100.25, None, None, None)
    full = got["a", 8]
    assert (full["probe"], full["lon"], full["lat"], full["alt"], full["x"], full["y"], full["local_x"], full["z"], full["elevation"]) == (2, 3.5, 48.25, 35, 500100.5, 5300200.25, 1.5, 0.1, 36)
    assert [got["b", 3][c] for c in ("x", "y", "z", "value")] == [1.5, 2.5, 0, 100.25]
    lost = got["b", 4]
    assert [lost[c] for c in ("x", "y", "z", "value", "lat", "alt")] == [-999, -999, 0, 7.5, 48.25, 35] and abs(lost["lon"] - 3.51) < 1e-12


def test_uxo_round_trip_with_places(spark, tmp_path):
    p = spark.createDataFrame([("s", 0, 7, 1.25, 2.5, 0.5, 100.5, 3.25, 48.5, 500000.5, 5300000.25)], "survey_id string, pid bigint, track int, x double, y double, z double, value double, lon double, lat double, east double, north double")
    sinks.write_uxo(p, str(tmp_path / "u"), name="field", unit="nT")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "u")).collect()]
    assert lines[:2] == ["[001]\tFile Format\tUXO100", "[002]\tProject name\tfield"] and "[022]\tMeasuring range min\t100.50" in lines and "[041]\tColumn separator\ttab" in lines
    assert lines[-1] == "[072]\t1.250\t2.500\t0.500\t100.50\t00007\t3°15.00000000\t48°30.00000000\t0.000\t500000.500\t5300000.250\t0.000"
    r = files.read_uxo(spark, str(tmp_path / "u")).first()
    assert [r[c] for c in ("local_x", "local_y", "z", "value", "lon", "lat", "x", "y")] == [1.25, 2.5, 0.5, 100.5, 3.25, 48.5, 500000.5, 5300000.25]


def test_heads_of_many_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text("junk\nx,y,v\n" + "".join(f"{k},{i},{i}\n" for i in range(4)))
    df = files.read_ascii(spark, str(tmp_path / "*.csv"), sep=",", column_map={"x": "x", "y": "y", "value": "v"}, skip_rows=1, header=True)
    assert sorted((r["survey_id"], r["y"]) for r in df.collect()) == [(f"f{k}", float(i)) for k in range(3) for i in range(4)]


def test_layers_and_extents(spark):
    grid, info = _survey(spark)
    doc = __import__("json").loads(sinks.grid_matrix([grid, grid], info).first()["json"])
    assert len(doc["grid"]) == 2 and doc["grid"][0] == doc["grid"][1] == [[1.5, 2.25, None], [4.0, -5.5, 6.0]]
    part, ends = G.crop_extent(grid, info, xmin=10.5, ymin=5.5)
    assert _cells(part) == {(0, 0): -5.5, (0, 1): 6.0} and tuple(ends.first())[1:] == (2, 1, 11.0, 12.0, 6.0, 6.0)
    assert sorted((r["x"], r["y"], r["value"]) for r in G.as_rows(grid, info).where("value is not null").collect())[0] == (10.0, 5.0, 1.5)


def test_windows_larger_than_the_grid(spark):
    """9 x 9 windows on 3 x 3 cells, mirrored without end."""
    z = np.arange(9.0).reshape(3, 3)
    grid = spark.createDataFrame([("g", i, j, float(v)) for (i, j), v in np.ndenumerate(z)], "survey_id string, iy int, ix int, z double")
    wide = np.pad(z, 4, mode="symmetric")
    got = _cells(G.separate_trends(grid, (9, 9), "regional"))
    mid = _cells(G.median_filter(grid, (9, 9)))
    for i, j in got:
        assert abs(got[i, j] - wide[i : i + 9, j : j + 9].mean()) < 1e-9 and mid[i, j] == np.median(wide[i : i + 9, j : j + 9])


def test_cmd_segments(spark, tmp_path):
    f = tmp_path / "log.dat"
    f.write_text("x[m]\ty[m]\tTime\tCond.1[mS/m]\tInph.1[ppt]\n0\t0\t10:00:00\t1\t2\n0\t9\t10:00:01\t3\t4\n0\t10\t10:00:02\t5\t6\n0\t10\n1\t0\t10:00:03\t7\t8\n1\t10\t10:00:04\t9\t1\n")
    got = files.read_cmd(spark, str(f)).orderBy("pid").collect()
    assert [(r["segment"], r["y"], r["cond"]) for r in got] == [(0, 0, 1), (0, 5, 3), (0, 10, 5), (1, 0, 7), (1, 10, 9)]


def test_controls_and_overlays(spark, tmp_path):
    f = tmp_path / "c.txt"
    f.write_text("UTM;T;31\n9;100;200;0;0\n12;110;200;10;0\n")
    system, rows = files.read_controls(spark, str(f))
    assert system == {"system": "UTM", "letter": "T", "zone": "31"}
    assert [tuple(r) for r in rows.orderBy("num").collect()] == [(1, 100, 200, 0, 0), (2, 110, 200, 10, 0)]
    assert sinks.controls_text(["UTM", "T", "31"], rows)[1] == "1;100.0;200.0;0.0;0.0"
    w = sinks.world_file([(0, 0), (10, 0), (10, 20), (0, 20)], 10, 20).split()
    assert [float(v) for v in w] == [1, 0, 0, -1, -0.5, 20.5]
    assert "LatLonQuad" in sinks.kml_overlay("a.png", [(0, 0)] * 4) and "<name>a</name>" in sinks.kml([("a", 1.0, 2.0)])


def test_lattice_and_bins(spark):
    p = spark.createDataFrame([("s", i, 0, float(x), float(y), float(x + y)) for i, (x, y) in enumerate([(0, 0), (0.5, 0), (2, 2), (1, 1)])], "survey_id string, pid bigint, track int, x double, y double, value double")
    info = G.grid_info(p, 1.0, 1.0)
    got = {(r["iy"], r["ix"]): r["z"] for r in G.bin_points(p, info, True).collect()}
    assert got == {(0, 0): 0.25, (0, 1): None, (1, 0): None, (1, 1): 3.0}


def test_ascii_files_with_settings_of_their_own(spark, tmp_path):
    """Delimiter, names and their order per file; quoted fields, comments after values, decimal commas, blanks."""
    (tmp_path / "a.csv").write_text("# made by hand\nx;y;value\n1,5;2;3,5 # note\n2;3;\n")
    (tmp_path / "b.csv").write_text("y,value,x\n20,7,10\n21,nan,11\n")
    (tmp_path / "c.csv").write_text('"x","y","value","remark"\n"5","6","7","a, b"\n8,9,"10","say ""no"" # not"\n')
    (tmp_path / "d.csv").write_text("x y value\n 1   2  3\n4 5 6\n")
    df = files.read_ascii(spark, str(tmp_path / "*.csv"), column_map={"x": "x", "y": "y", "value": "value"}, header=True)
    got = sorted((r["survey_id"], r["x"], r["y"], r["value"]) for r in df.collect())
    assert [g[:3] for g in got] == [("a", 1.5, 2.0), ("a", 2.0, 3.0), ("b", 10.0, 20.0), ("b", 11.0, 21.0), ("c", 5.0, 6.0), ("c", 8.0, 9.0), ("d", 1.0, 2.0), ("d", 4.0, 5.0)]
    assert [g[3] for g in got] == [3.5, None, 7.0, None, 7.0, 10.0, 3.0, 6.0]
    assert {r["survey_id"]: (r["x_min"], r["x_max"], r["y_min"], r["y_max"]) for r in files.limits(df).collect()}["b"] == (10.0, 11.0, 20.0, 21.0)
    seen = {(r["file"][-5:], r["row"]): r["value"] for r in files.peek(spark, str(tmp_path / "*.csv"), 2).collect()}
    assert seen["a.csv", 0] == "x;y;value" and len(seen) == 8


def test_ascii_is_loud(spark, tmp_path):
    (tmp_path / "good.dat").write_text("1,2,3\n,5,6\nnan,1,1\n4,5,oops\n")
    (tmp_path / "bad.dat").write_text("1,2,3\nonly text\n")
    (tmp_path / "other.dat").write_text("a,b\n1,2\n")
    assert sorted((r["x"], r["value"] is None) for r in files.read_ascii(spark, str(tmp_path / "good.dat")).collect()) == [(1.0, False), (4.0, True)]
    with pytest.raises(Exception, match="bad.dat"):
        files.read_ascii(spark, str(tmp_path / "bad.dat")).collect()
    assert files.read_ascii(spark, str(tmp_path / "bad.dat"), refuse="none").count() == 1
    (tmp_path / "text.dat").write_text("1,2,3\nfour,5,6\n")
    assert files.read_ascii(spark, str(tmp_path / "text.dat")).count() == 1
    with pytest.raises(Exception, match="text.dat"):
        files.read_ascii(spark, str(tmp_path / "text.dat"), refuse="all").collect()
    with pytest.raises(Exception, match="no column 'x' in .*other.dat"):
        files.read_ascii(spark, str(tmp_path / "other.dat"), header=True, column_map={"x": "x", "y": "b", "value": "a"}).collect()
    with pytest.raises(ValueError, match="row of names"):
        files.read_ascii(spark, str(tmp_path / "other.dat"), column_map={"x": "x", "y": "b"})


def test_ascii_names_in_a_row_of_their_own(spark, tmp_path):
    (tmp_path / "f.txt").write_text("Site 7\nX|Y|V\nm|m|nT\n1|2|3\n4|5|6\n")
    df = files.read_ascii(spark, str(tmp_path / "f.txt"), column_map={"x": "X", "y": "Y", "value": "V"}, fields_row=1, skip_rows=3)
    assert sorted((r["x"], r["y"], r["value"]) for r in df.collect()) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
