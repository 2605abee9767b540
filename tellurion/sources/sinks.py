"""File sinks: delimited points, Surfer grids, UXO, matrix JSON, control points, KML, world files.

Text sinks are written by Spark; a grid file is one object by its format, so each survey's cells go to one
task, which returns the file's bytes as a row.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurion.operators.grids import to_frame

from .files import BLANK, SURFER6, SURFER6_ASCII, SURFER7

WRITERS: dict[str, Callable] = {}


def register_writer(name: str):
    def register(f: Callable) -> Callable:
        WRITERS[name] = f
        return f

    return register


@register_writer("ascii")
def write_points(points: DataFrame, path: str, columns: dict[str, str] | None = None, sep: str = ",", drop_missing: bool = False) -> None:
    """Points as delimited text with a header, in order of pid. columns: header to column."""
    columns = columns or {"x": "x", "y": "y", "value": "value", "track": "track"}
    lost = [c for c in columns.values() if c not in points.columns]
    if lost:
        raise ValueError(f"no such columns: {lost}")
    df = points.select("pid", *[F.col(c).alias(h) for h, c in columns.items()])
    df = df.dropna("any", subset=list(columns)) if drop_missing else df
    df.orderBy("pid").drop("pid").write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def surfer_bytes(z: np.ndarray, x_min: float, x_max: float, y_min: float, y_max: float, fmt: str = SURFER7) -> bytes:
    """A grid (rows from y_min, NaN for blank) in one of the Surfer formats."""
    rows, cols = z.shape
    ok = z[np.isfinite(z)]
    lo, hi = (float(ok.min()), float(ok.max())) if len(ok) else (0.0, 0.0)
    filled = np.where(np.isfinite(z), z, BLANK)
    if fmt == SURFER7:
        dx, dy = (x_max - x_min) / max(cols - 1, 1), (y_max - y_min) / max(rows - 1, 1)
        grid = struct.pack("<2i8d", rows, cols, x_min, y_min, dx, dy, lo, hi, 0.0, BLANK)
        body = filled.astype("<f8").tobytes()
        return b"DSRB" + struct.pack("<2i", 4, 2) + b"GRID" + struct.pack("<i", 72) + grid + b"DATA" + struct.pack("<i", len(body)) + body
    if fmt == SURFER6:
        return b"DSBB" + struct.pack("<2h6d", cols, rows, x_min, x_max, y_min, y_max, lo, hi) + filled.astype("<f4").tobytes()
    if fmt == SURFER6_ASCII:
        head = f"DSAA\n{cols} {rows}\n{x_min:g} {x_max:g}\n{y_min:g} {y_max:g}\n{lo:g} {hi:g}\n"
        return (head + "\n".join(" ".join(f"{v:g}" for v in row) for row in filled) + "\n").encode("ascii")
    raise ValueError(f"unknown grid format {fmt!r}")


def grid_files(grid: DataFrame, info: DataFrame, fmt: str = SURFER7) -> DataFrame:
    """(survey_id, content): one grid file per survey, made by the task that holds it."""

    def build(g: pd.DataFrame) -> pd.DataFrame:
        i = g.iloc[0]
        raw = surfer_bytes(to_frame(g), i["x_min"], i["x_max"], i["y_min"], i["y_max"], fmt)
        return pd.DataFrame({"survey_id": [i["survey_id"]], "content": [raw]})

    return grid.join(info, "survey_id").groupBy("survey_id").applyInPandas(build, "survey_id string, content binary")


@register_writer("surfer")
def write_grid(grid: DataFrame, info: DataFrame, path: str, fmt: str = SURFER7) -> None:
    """One survey's grid to one file, written by the task that holds it, at a path or URI that this task reaches."""
    n = grid.select("survey_id").distinct().limit(2).count()
    if n != 1:
        raise ValueError(f"one survey goes to one grid file, not {'none' if not n else 'several'}")
    target = path if "://" in path else Path(path).absolute().as_uri()

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for f in frames:
            for raw in f["content"]:
                fs, at = FileSystem.from_uri(target)
                with fs.open_output_stream(at) as out:
                    out.write(raw)
                yield pd.DataFrame({"bytes": [len(raw)]})

    grid_files(grid, info, fmt).mapInPandas(save, "bytes bigint").collect()  # one number


def grid_matrix(grids: list[DataFrame], info: DataFrame) -> DataFrame:
    """(survey_id, json): any number of equally large grids as the layers of one matrix."""
    layers = None
    for k, g in enumerate(grids):
        one = g.select("survey_id", F.lit(k).alias("layer"), "iy", "ix", "z")
        layers = one if layers is None else layers.unionAll(one)
    rows = layers.groupBy("survey_id", "layer", "iy").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "z"))), lambda s: s["z"]).alias("r"))
    flat = rows.groupBy("survey_id", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("iy", "r"))), lambda s: s["r"]).alias("g"))
    return _document(flat.groupBy("survey_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "g"))), lambda s: s["g"]).alias("g")), info)


#: Tags and titles of the head of a UXO file, in order.
UXO_HEAD = [
    ("001", "File Format"), ("002", "Project name"), ("003", "Service provider"), ("004", "Acolyte"), ("005", "Creation Date"), ("006", "Evaluator"), ("007", "Transfer date"), ("008", "Software-Name"),
    ("009", "Field name"), ("010", "Field type"), ("011", "Data source type"), ("012", "Firmware/Software"), ("013", "DLG-Serial-no."), ("014", "Calibration date"), ("015", "Detector type"),
    ("016", "Serial no."), ("017", "Sensor type"), ("018", "Serial no."), ("019", "Calibration date"), ("020", "Number of sensors"), ("021", "Measurand"), ("022", "Measuring range min"),
    ("023", "Measuring range max"), ("024", "Data gap"), ("025", "Positioning"), ("026", "Measuring speed"), ("027", "Coordinate system"), ("028", "Local coordinates"), ("029", "Sensor distance"),
    ("030", "Data point spacing"), ("031", "Field comment"), ("041", "Column separator"), ("042", "Decimal separator"), ("043", "Coding"),
]
UXO_COLUMNS = ["X [m]", "Y [m]", "Z [m]", "Value", "Track", "WGS84-Lon", "WGS84-Lat", "WGS84-Alt [m]", "Local East [m]", "Local North [m]"]
UXO_FORMATS = ["x.xxx", "x.xxx", "x.xxx", "x.xx", "xxxxx", "x°xx.xxxxxxxx", "x°xx.xxxxxxxx", "x.xxx", "x.xxx", "x.xxx", "x.xxx"]


@register_writer("uxo")
def write_uxo(points: DataFrame, path: str, name: str = "", unit: str | None = None, crs: str | None = None) -> None:
    """UXO text: head lines, then [072] data lines in order of pid: x, y, z, value, track, and longitude, latitude, altitude, east, north,
    elevation where the columns are there; z, altitude and elevation are 0 unless given."""
    from tellurion.functions.geodesy import format_angle

    spark, has = points.sparkSession, set(points.columns)
    given = {"001": "UXO100", "002": name, "021": unit, "027": "WGS84" if {"lon", "lat"} <= has else None, "028": crs, "041": "tab", "042": "."}
    rows = [(f"[{t}]", title, given.get(t)) for t, title in UXO_HEAD]
    heads = ["\t".join(v for v in r if v) for r in rows] + ["\t".join(["[070]", *(f"{c} [{unit}]" if unit and c == "Value" else c for c in UXO_COLUMNS)]), "\t".join(["[071]", *UXO_FORMATS])]
    head = spark.createDataFrame([(i - len(heads), h) for i, h in enumerate(heads)], "pid bigint, value string")
    span = points.agg(F.format_string("%.2f", F.min("value").cast("double")).alias("lo"), F.format_string("%.2f", F.max("value").cast("double")).alias("hi"))
    tag = F.substring("value", 2, 3)
    head = head.crossJoin(F.broadcast(span)).select("pid", F.concat_ws("\t", "value", F.when(tag == "022", F.col("lo")).when(tag == "023", F.col("hi"))).alias("value"))  # one row of two numbers

    def num(c: str, f: str, default: float | None = None):
        v = F.col(c).cast("int" if f.endswith("d") else "double") if c in has else F.lit(None).cast("double")
        v = v if default is None else F.coalesce(v, F.lit(default))
        return F.when(v.isNotNull(), F.format_string(f, v)).otherwise("")

    cols = [num("x", "%.3f"), num("y", "%.3f"), num("z", "%.3f", 0.0), num("value", "%.2f"), num("track", "%05d")]
    geographic, local = {"lon", "lat"} <= has, {"east", "north"} <= has
    if geographic or local:
        cols += [F.coalesce(format_angle(F.col(c)), F.lit("")) if geographic else F.lit("") for c in ("lon", "lat")] + [num("alt", "%.3f", 0.0)]
    if local:
        cols += [num("east", "%.3f"), num("north", "%.3f"), num("elevation", "%.3f", 0.0)]
    body = points.select("pid", F.concat_ws("\t", F.lit("[072]"), *cols).alias("value"))
    head.unionAll(body).orderBy("pid").select("value").write.mode("overwrite").text(path)


def matrix_json(grid: DataFrame, info: DataFrame) -> DataFrame:
    """(survey_id, json): grids as matrix JSON text."""
    return grid_matrix([grid], info)


def _document(layers: DataFrame, info: DataFrame) -> DataFrame:
    g = layers.join(info, "survey_id")
    gap = lambda a: F.when(F.col(f"n{a}") > 1, (F.col(f"{a}_max") - F.col(f"{a}_min")) / (F.col(f"n{a}") - 1)).otherwise(0.0)
    none = F.array().cast("array<string>")
    doc = F.struct(F.col("g").alias("grid"), F.array("x_min", "x_max", "y_min", "y_max").alias("ext"), F.array("nx", "ny").alias("pxy"), F.array(gap("x"), gap("y")).alias("step"), none.alias("ncx"), none.alias("ncy"), none.alias("ncz"))
    return g.select("survey_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


@register_writer("matrix")
def write_matrix(grid: DataFrame, info: DataFrame, path: str) -> None:
    matrix_json(grid, info).select("json").write.mode("overwrite").text(path)


def controls_text(system: list[str], controls: DataFrame) -> list[str]:
    """Lines of a control-point file (a few rows)."""
    rows = controls.orderBy("num").collect()
    return [";".join(system)] + [";".join(str(v) for v in (r["num"], r["east"], r["north"], r["x"], r["y"])) for r in rows]


def kml(places: list[tuple[str, float, float]]) -> str:
    """Placemarks (name, longitude, latitude)."""
    marks = "".join(f"<Placemark><name>{n}</name><Point><coordinates>{x!r},{y!r}</coordinates></Point></Placemark>" for n, x, y in places)
    return f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>{marks}</Document></kml>'


def kml_overlay(picture: str, quad: list[tuple[float, float]]) -> str:
    """A picture laid over four corners (longitude, latitude), from the lower left counter-clockwise."""
    corners = " ".join(f"{x!r},{y!r}" for x, y in quad)
    return f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:gx="http://www.google.com/kml/ext/2.2"><GroundOverlay><Icon><href>{picture}</href></Icon><gx:LatLonQuad><coordinates>{corners}</coordinates></gx:LatLonQuad></GroundOverlay></kml>'


def world_file(quad: list[tuple[float, float]], width: int, height: int) -> str:
    """Six lines of a world file from the corners BL, BR, TR, TL in map units."""
    (x0, y0), (x1, y1), _, (x3, y3) = quad
    a, d = (x1 - x0) / width, (y1 - y0) / width
    b, e = (x0 - x3) / height, (y0 - y3) / height
    return "\n".join(repr(float(v)) for v in (a, d, b, e, x3 - a / 2, y3 - e / 2)) + "\n"


def write_history(history: tuple, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(list(history), f, indent=1)
