"""File sources: delimited points, three Surfer grid formats, UXO, CMD logs, matrix JSON, control points.

Text formats are read as text by Spark and parsed with column functions; binary grids come through the
binaryFile source, one file per task row. Every source turns NaN and blanks to NULL and fails loudly.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellurion.model import Survey
from tellurion.operators.statistics import settled

READERS: dict[str, tuple[Callable, str, dict]] = {}
EXTENSIONS = {".csv": "ascii", ".txt": "ascii", ".dat": "ascii", ".xyz": "ascii", ".grd": "surfer", ".uxo": "uxo", ".json": "matrix"}
DELIMITERS = ["\t", ";", ",", "|", " "]
SURFER7, SURFER6 = "surfer7bin", "surfer6bin"
SURFER6_ASCII = "surfer6ascii"
#: Blanks of the grid formats.
BLANK = 1.70141e38


def register_reader(name: str, description: str = "", default_map: dict | None = None):
    def register(f: Callable) -> Callable:
        READERS[name] = (f, description, default_map or {})
        return f

    return register


def reader_formats() -> dict[str, str]:
    return {n: d for n, (_, d, _) in READERS.items()}


def sniff_delimiter(line: str) -> str:
    """The delimiter of a line by priority."""
    return next((d for d in DELIMITERS if d in line.strip()), ",")


def number(c: Column) -> Column:
    """Text as a finite double, with comma or dot; anything else is NULL."""
    v = F.regexp_replace(F.trim(c), ",", ".").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, begin, line, value): lines in the order of their file, and whether they are of the file's first split. Lines of one file stay in order within its splits."""
    begin = F.col("_metadata.file_block_start") == 0
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), begin.alias("begin"), "value", F.monotonically_increasing_id().alias("line"))


def peek(spark: SparkSession, path: str | list[str], n: int = 5) -> DataFrame:
    """(file, row, value): the first n lines of each file that are neither blank nor comments, from row 0. Only files' first splits are ranked, which are bounded."""
    lines = _numbered(spark, path).where("begin").where(_telling())
    row = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return lines.withColumn("row", row).where(F.col("row") < n).select("file", "row", "line", "value")


def limits(points: DataFrame) -> DataFrame:
    """(survey_id, x_min, x_max, y_min, y_max): one row per file of a reading."""
    return points.groupBy("survey_id").agg(*[f(F.col(a)).alias(f"{a}_{k}") for a in "xy" for k, f in (("min", F.min), ("max", F.max))])


def _telling() -> Column:
    return ~F.ltrim("value").startswith("#") & (F.trim("value") != "")


def _fields(line: Column, sep: Column) -> Column:
    """The fields of a line, trimmed and without quotes; a delimiter inside double quotes parts nothing, a comment after a blank and '#' is cut off."""
    quoted = F.contains(line, F.lit('"'))
    bare = F.when(quoted, line).otherwise(F.regexp_replace(line, r"\s+#.*$", ""))
    pattern = F.when(sep == " ", r"\s+").when(sep == "|", r"\|").otherwise(sep)
    outside = F.when(quoted, r'(?=(?:[^"]*"[^"]*")*[^"]*$)').otherwise("")
    parts = F.split(F.when(sep == " ", F.trim(bare)).otherwise(bare), F.concat(pattern, outside))
    return F.transform(parts, lambda f: F.regexp_replace(F.regexp_replace(F.trim(f), r'^"(.*)"$', "$1"), '""', '"'))


@register_reader("ascii", "delimited text", {"x": 0, "y": 1, "value": 2})
def read_ascii(
    spark: SparkSession, path: str | list[str], sep: str | None = None, column_map: dict[str, int | str] | None = None, skip_rows: int = 0, header: bool = False, survey_id: str | None = None,
    fields_row: int | None = None, refuse: str = "short",
) -> DataFrame:
    """Points from delimited text; '#' opens comments. Columns by place, or by name where names stand in the row after skip_rows (header) or in fields_row.

    Each file has its own delimiter, unless given, and its own names. Rows whose x or y is no number are left out, a bad or missing value is NULL. A row
    too short to have an x and y, as from another delimiter, and a file without a wanted name stop the reading with the file's name. refuse="all" stops at
    texts in place of coordinates too, refuse="none" leaves short rows out.
    """
    if refuse not in ("short", "all", "none"):
        raise ValueError(f"refuse must be short, all or none, not {refuse!r}")
    if sep is not None and sep not in DELIMITERS:
        raise ValueError(f"sep must be one of {DELIMITERS}")
    column_map = column_map or {"x": 0, "y": 1, "value": 2}
    named = fields_row if fields_row is not None else skip_rows if header else None
    first = max(skip_rows, 0 if named is None else named + 1)  # rows before the data
    lines = _numbered(spark, path).where(_telling())
    if first or sep is None:
        at = lambda row: F.max(F.when(F.col("row") == row, F.col("value")))
        shown = at(named) if named is not None else F.coalesce(at(first), at(first - 1))
        sniffed = F.coalesce(*[F.when(F.contains(F.trim(shown), F.lit(d)), F.lit(d)) for d in DELIMITERS], F.lit(",")) if sep is None else F.lit(sep)
        heads = peek(spark, path, first + 1).groupBy("file").agg(F.max(F.when(F.col("row") < first, F.col("line"))).alias("__last"), sniffed.alias("__sep"), (at(named) if named is not None else F.lit(None).cast("string")).alias("__names"))
        heads = settled(heads.withColumn("__names", _fields(F.col("__names"), F.col("__sep"))))
        lines = lines.join(heads, "file", "left").where("__last is null or line > __last")
    else:
        lines = lines.withColumns({"__sep": F.lit(sep), "__names": F.lit(None).cast("array<string>")})
    lines = lines.withColumn("__parts", _fields(F.col("value"), F.col("__sep")))

    def pick(key: str) -> Column:
        at = column_map.get(key)
        if at is None:
            return F.lit(None).cast("string")
        if isinstance(at, int):
            return F.try_element_at("__parts", F.lit(at + 1))
        if named is None:
            raise ValueError(f"column {at!r} needs a row of names: header=True or fields_row")
        place = F.array_position("__names", at).cast("int")
        lost = F.raise_error(F.concat(F.lit(f"no column {at!r} in "), F.col("file"))).cast("string")
        return F.when(place > 0, F.try_element_at("__parts", place)).otherwise(lost)

    def coordinate(key: str) -> Column:
        text = pick(key)
        x = number(text)
        wrong = pick("x").isNull() | pick("y").isNull()
        if refuse == "all":
            wrong |= (F.trim(text) != "") & ~F.lower(F.trim(text)).isin("nan", "null", "none", "na", "*") & x.isNull()
        said = F.raise_error(F.concat(F.lit(f"no {key} in a row of "), F.col("file"), F.lit(": "), F.col("value"))).cast("double")
        return x if refuse == "none" else F.when(wrong, said).otherwise(x)

    sid = F.lit(survey_id) if survey_id else F.regexp_extract("file", r"([^/]+?)(?:\.[^.]*)?$", 1)
    out = lines.select(sid.alias("survey_id"), F.col("line").alias("pid"), number(pick("track")).cast("int").alias("track"), coordinate("x").alias("x"), coordinate("y").alias("y"), number(pick("value")).alias("value"), *[number(pick(c)).alias(c) for c in ("east", "north", "lon", "lat")])
    return out.where("x is not null and y is not null")


def parse_surfer(raw: bytes) -> tuple[np.ndarray, dict[str, float]]:
    """(values with NaN blanks, rows from y_min; extents) of a Surfer 7 binary, 6 binary or 6 ascii grid."""
    tag = raw[:4]
    if tag == b"DSRB":
        at, head, z = 8 + struct.unpack("<i", raw[4:8])[0], None, None
        while at + 8 <= len(raw):
            name, n = raw[at : at + 4], struct.unpack("<i", raw[at + 4 : at + 8])[0]
            body = raw[at + 8 : at + 8 + n]
            if name == b"GRID":
                head = struct.unpack("<2i8d", body[:72])
            elif name == b"DATA":
                z = np.frombuffer(body, "<f8")
            at += 8 + n
        if head is None or z is None:
            raise ValueError("a Surfer 7 grid without GRID or DATA")
        rows, cols, x0, y0, dx, dy, *_, blank = head
        z = np.where(z >= min(blank, BLANK), np.nan, z).reshape(rows, cols)
        return z, {"x_min": x0, "x_max": x0 + dx * (cols - 1), "y_min": y0, "y_max": y0 + dy * (rows - 1)}
    if tag == b"DSBB":
        cols, rows = struct.unpack("<2h", raw[4:8])
        x0, x1, y0, y1, _, _ = struct.unpack("<6d", raw[8:56])
        z = np.frombuffer(raw[56 : 56 + 4 * rows * cols], "<f4").astype(float).reshape(rows, cols)
        return np.where(z >= BLANK * (1 - 1e-6), np.nan, z), {"x_min": x0, "x_max": x1, "y_min": y0, "y_max": y1}
    if tag == b"DSAA":
        t = raw.decode("ascii").split()[1:]
        cols, rows = int(t[0]), int(t[1])
        x0, x1, y0, y1 = map(float, t[2:6])
        z = np.array(t[8 : 8 + rows * cols], float).reshape(rows, cols)
        return np.where(z >= BLANK * (1 - 1e-6), np.nan, z), {"x_min": x0, "x_max": x1, "y_min": y0, "y_max": y1}
    raise ValueError(f"not a Surfer grid: {tag!r}")


@register_reader("surfer", "Surfer grids, binary 7, binary 6 and ascii 6")
def read_surfer(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(grid, grid_info) of any number of grid files; a file is parsed by the task that reads it."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^.]*)?$", 1).alias("survey_id"), "content")

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sid, raw in zip(b["survey_id"], b["content"], strict=True):
                z, _ = parse_surfer(raw)
                iy, ix = np.indices(z.shape)
                yield pd.DataFrame({"survey_id": sid, "iy": iy.ravel(), "ix": ix.ravel(), "z": z.ravel()})

    def infos(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sid, raw in zip(b["survey_id"], b["content"], strict=True):
                z, e = parse_surfer(raw)
                yield pd.DataFrame([{"survey_id": sid, "nx": z.shape[1], "ny": z.shape[0], **e}])

    grid = files.mapInPandas(cells, "survey_id string, iy int, ix int, z double").withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    return grid, files.mapInPandas(infos, "survey_id string, nx int, ny int, x_min double, x_max double, y_min double, y_max double")


@register_reader("uxo", "UXO text logs")
def read_uxo(spark: SparkSession, path: str | list[str], survey_id: str | None = None) -> DataFrame:
    """Points from [072] lines: x, y, z, value, track (or track-probe), optional lon, lat, altitude, then east, north, elevation.

    Each line tells its separator (tab, ';', ',', '|' or blank in this order), so files may differ; decimals have a comma or a dot. A line that
    begins with three separators has no local place: x and y are then -999, z is 0. Where a line has east and north, these are its
    x and y; the local ones are in local_x and local_y always.
    """
    from tellurion.functions.geodesy import parse_angle

    lines = _numbered(spark, path).where(F.col("value").startswith("[072]"))
    body = F.substring("value", 6, 1 << 20)
    sep = F.lit(" ")
    for d in ("|", ",", ";", "\t"):
        sep = F.when(F.contains(body, F.lit(d)), F.lit(d)).otherwise(sep)
    even = F.rtrim(F.replace(body, sep, F.lit("\t")))
    lines = lines.select("file", "line", F.startswith(even, F.lit("\t\t\t")).alias("nowhere"), F.split(F.regexp_replace(even, r"^\t+", ""), "\t").alias("p"))
    text = lambda i: F.try_element_at("p", F.lit(i) - F.when(F.col("nowhere"), 3).otherwise(0))
    at = lambda i: number(text(i))
    local = lambda i, v: F.when(F.col("nowhere"), F.lit(v)).otherwise(number(F.try_element_at("p", F.lit(i))))
    sid = F.lit(survey_id) if survey_id else F.regexp_extract("file", r"([^/]+?)(?:\.[^.]*)?$", 1)
    angle = lambda i: F.coalesce(at(i), parse_angle(F.regexp_replace(text(i), ",", ".")))
    number_in = lambda pattern: F.regexp_extract(text(5), pattern, 1).try_cast("int")
    out = lines.select(
        sid.alias("survey_id"), F.col("line").alias("pid"), number_in(r"^\s*(\d+)").alias("track"), number_in(r"-\s*(\d+)").alias("probe"), local(1, -999.0).alias("local_x"), local(2, -999.0).alias("local_y"),
        local(3, 0.0).alias("z"), at(4).alias("value"), angle(6).alias("lon"), angle(7).alias("lat"), at(8).alias("alt"), at(9).alias("east"), at(10).alias("north"), at(11).alias("elevation"),
    )
    placed = F.col("east").isNotNull() & F.col("north").isNotNull()
    return out.withColumns({"x": F.when(placed, F.col("east")).otherwise(F.col("local_x")), "y": F.when(placed, F.col("north")).otherwise(F.col("local_y"))})


def read_cmd(spark: SparkSession, path: str, survey_id: str | None = None) -> DataFrame:
    """CMD logs by their header: local or satellite positions, then Cond.k / Inph.k pairs.

    In grid logs lines of two fields end a segment, whose positions are spread evenly from its first to its
    last point. Columns: survey_id, pid, segment, x, y, date, time, and the channels in long form (channel, cond, inph).
    """
    lines = _numbered(spark, path).where(F.trim("value") != "")
    head = lines.orderBy("line").limit(1).first()
    if head is None:
        raise ValueError("an empty log")
    names = [n.strip() for n in head["value"].split("\t")]
    low = [n.lower() for n in names]
    p = F.split("value", "\t")

    def pick(*options: str, text: bool = False) -> Column:
        i = next((low.index(o) for o in options if o in low), None)
        if i is None:
            return F.lit(None).cast("string" if text else "double")
        e = F.try_element_at(p, F.lit(i + 1))
        return F.trim(e) if text else number(e)

    channels = sorted({int(m.group(1)) for n in names if (m := re.match(r"Cond\.(\d+)", n))})
    if not channels:
        raise ValueError("no Cond.k columns in the header")
    by = lambda kind, k: next((n.lower() for n in names if n.startswith(f"{kind}.{k}[")), "")
    parts = F.array(*[F.struct(F.lit(k).alias("channel"), pick(by("Cond", k)).alias("cond"), pick(by("Inph", k)).alias("inph")) for k in channels])
    sid = F.lit(survey_id) if survey_id else F.regexp_extract("file", r"([^/]+?)(?:\.[^.]*)?$", 1)
    body = lines.where(F.col("value") != head["value"]).withColumn("__end", (F.size(F.filter(p, lambda e: F.trim(e) != "")) <= 2).cast("int"))
    # ends before a line: those in earlier splits of the file (few rows), and those before it in its own
    body = body.withColumn("__split", F.shiftright("line", 33))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    splits = body.groupBy("file", "__split").agg(F.sum("__end").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before("file").orderBy("__split")), F.lit(0))).drop("n")
    here = F.coalesce(F.sum("__end").over(before("file", "__split").orderBy("line")), F.lit(0))
    body = body.withColumn("__here", here).where("__end = 0").join(splits, ["file", "__split"])
    body = body.withColumn("segment", (F.col("__before") + F.col("__here")).cast("int"))
    lat, lon = pick("latitude"), pick("longitude")
    east, north, local = pick("easting", "x[m]"), pick("northing", "y[m]"), "x[m]" in low
    if "latitude" in low:
        from tellurion.functions.geodesy import utm

        east, north, _ = utm(lat, lon)
    out = body.select(sid.alias("survey_id"), F.col("line").alias("pid"), "segment", east.alias("x"), north.alias("y"), pick("date", text=True).alias("date"), pick("time", text=True).alias("time"), F.inline(parts))
    if local:
        from tellurion.operators.tracks import interpolate_segments

        one = interpolate_segments(out.select("survey_id", "pid", "segment", "x", "y").distinct(), by=["survey_id", "segment"])
        out = out.drop("x", "y").join(one, ["survey_id", "pid", "segment"])
    return out


_MATRIX = "grid array<array<array<double>>>, ext array<double>, pxy array<int>, step array<double>, ncx array<string>, ncy array<string>, ncz array<string>"


@register_reader("matrix", "matrix JSON")
def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(survey_id, layer, iy, ix, x, y, z) of matrix JSON files; x and y to 4 decimals."""
    d = spark.read.schema(_MATRIX).option("multiLine", True).json(path).withColumn("survey_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^.]*)?$", 1))
    d = d.select("survey_id", "ext", "step", F.posexplode("grid").alias("layer", "g")).select("survey_id", "ext", "step", "layer", F.posexplode("g").alias("iy", "r")).select("survey_id", "ext", "step", "layer", "iy", F.posexplode("r").alias("ix", "z"))
    return d.select("survey_id", "layer", "iy", "ix", F.bround(F.col("ext")[0] + F.col("ix") * F.col("step")[0], 4).alias("x"), F.bround(F.col("ext")[2] + F.col("iy") * F.col("step")[1], 4).alias("y"), F.when(~F.isnan("z"), F.col("z")).alias("z"))


def read_controls(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """(reference system, control points num, east, north, x, y) from text: a head line, then rows; numbers count from 1."""
    lines = _numbered(spark, path).where(F.trim("value") != "")
    head = lines.orderBy("line").first()["value"]
    sep = sniff_delimiter(head) if re.search(r"[;,\t|]", head) else ";"
    parts = [h.strip() for h in head.split(sep)]
    system = {"system": parts[0], "letter": parts[1] if len(parts) > 1 else "", "zone": parts[2] if len(parts) > 2 else ""}
    p = F.split("value", re.escape(sep))
    at = lambda i: number(F.try_element_at(p, F.lit(i)))
    rows = lines.where(F.col("value") != head).withColumn("num", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    return system, rows.select("num", at(2).alias("east"), at(3).alias("north"), at(4).alias("x"), at(5).alias("y"))


def load_survey(spark: SparkSession, path: str, fileformat: str | None = None, **options) -> Survey:
    """A survey from a file, its format by extension or name."""
    ext = re.search(r"(\.[^./]+)$", path)
    name = fileformat or EXTENSIONS.get(ext.group(1).lower() if ext else "")
    if name not in READERS:
        raise ValueError(f"no reader for {path!r} (format {name!r}); known: {', '.join(READERS)}")
    got = READERS[name][0](spark, path, **options)
    title = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    if isinstance(got, tuple):
        return Survey(title, grid=got[0], grid_info=got[1])
    if name == "matrix":
        return Survey(title, grid=got.select("survey_id", "iy", "ix", "z"))
    return Survey(title, points=got)
