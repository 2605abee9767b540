r"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is WINDOW consecutive words of a benchmark item (all of them if there are fewer). Its shingles are runs of up to
SHINGLE words; a document that holds the window holds every one of them, so one necessary shingle finds it: the rarest, by counts over all documents.

1. Documents are read once. A bit map of the benchmark's shingle hashes (BITS at most, whatever the benchmark's size) picks
   places inside each document's array of words, before anything is exploded or shuffled. Picked places are written with the words around them.
2. Shingles are counted over these places and ordered by rarity. A window keeps its rarest as prefix; one with a shingle that never occurs is done.
3. Places and prefixes meet on the hash (an equi-join that Spark may broadcast or split). The prefix's offset gives the only possible start;
   bounds on start and length drop what overhangs the document, and the window's words are compared with those around the place.

Null and empty texts have no words, on both sides; benchmark rows with one id are one item with the windows of all of them, a null id is the empty text.
Windows don't span two rows. Very long texts are read whole; an item of thousands of words is as many windows. Rows of documents are judged one by one,
whatever their ids; an empty table on either side gives no hits. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: What a word is, and words in a window.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
WINDOW = 10
#: Words in a shingle; powers of two of the fewest and most bits of the map.
SHINGLE, FEWEST_BITS, BITS = 5, 12, 22
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """array<string>: words, only A-Z lower-cased; empty for null."""
    # texts without other than ASCII characters take the quick way to the same letters
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _runs(n: Column, width: Column | int, make: Callable[[Column], Column]) -> Column:
    """make(place from 1) for every run of width among n words; an empty array if there is none."""
    return F.transform(F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>")), make)


def _hash(w: Column, at: Column, width: Column | int) -> Column:
    return F.xxhash64(F.slice(w, at, width))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, window, m), distinct: the m words of each window, joined by blanks, which no word holds."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("m", F.least(F.size("w"), F.lit(window)))
    each = _runs(F.size("w"), F.col("m"), lambda i: F.array_join(F.slice("w", i, F.col("m")), " "))
    return w.select("item", "m", F.explode(each).alias("window")).distinct()


def _shingles(distinct: DataFrame) -> DataFrame:
    """(window, m, k, offset, h): all shingles of each distinct window."""
    w = distinct.withColumn("w", F.split("window", " ")).withColumn("k", F.least("m", F.lit(SHINGLE)))
    each = _runs(F.col("m"), F.col("k"), lambda i: F.struct((i - 1).alias("offset"), _hash(F.col("w"), i, F.col("k")).alias("h")))
    return w.select("window", "m", "k", F.explode(each).alias("s")).select("window", "m", "k", "s.offset", "s.h")


def _bit_map(shingles: DataFrame) -> tuple[str, int]:
    """The map as text (at most 2^BITS / 64 numbers, which is what comes to the driver) and its number of words."""
    known = shingles.select("h").distinct()
    size = 1 << (min(BITS, max(FEWEST_BITS, (32 * known.count()).bit_length())) - 6)
    cells = known.select(_cell(F.col("h"), size).alias("c"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("h"))).alias("b"))
    got = [0] * size
    for r in cells.groupBy("c").agg(F.bit_or("b").alias("b")).collect():
        got[r["c"]] = r["b"]
    return ",".join(map(str, got)), size


def _cell(h: Column, size: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(size - 1).cast("long")).cast("int")


def _bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(63).cast("long")).cast("int")


def _places(docs: DataFrame, shingles: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(row, id, n_words, j, pos, k, h, before, near): a row for each picked place, and one without place for each document without.

    j counts a document's places from 0. near: the words around the place that a window through it may hold, ``before`` of them left of it.
    """
    widths = sorted(r["k"] for r in shingles.select("k").distinct().collect())
    text, size = _bit_map(shingles)
    bits = F.split(F.lit(text), ",").cast("array<bigint>")

    def marked(h: Column) -> Column:
        return F.call_function("shiftright", F.get(bits, _cell(h, size)), _bit(h)).bitwiseAND(F.lit(1).cast("long")) == 1

    def picked(k: int) -> Column:
        at = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(at, lambda i: marked(_hash(F.col("w"), i, k))), lambda i: F.struct((i - 1).alias("pos"), F.lit(k).alias("k")))

    src = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).withColumn("row", F.monotonically_increasing_id())
    none = F.array().cast("array<struct<pos:int,k:int>>")
    all_picked = F.concat(none, *[picked(k) for k in widths])
    each = src.select("row", "id", F.size("w").cast("long").alias("n_words"), "w", F.posexplode_outer(all_picked).alias("j", "p"))
    reach = F.when(F.col("p.k") == SHINGLE, window - SHINGLE).otherwise(0)
    each = each.withColumn("before", F.least("p.pos", reach))
    near = F.slice("w", F.col("p.pos") - F.col("before") + 1, F.col("before") + F.col("p.k") + reach)
    return each.select("row", "id", "n_words", "j", "p.pos", "p.k", F.when(F.col("p").isNotNull(), _hash(F.col("w"), F.col("p.pos") + 1, F.col("p.k"))).alias("h"), "before", near.alias("near"))


def _verified(places: DataFrame, shingles: DataFrame) -> DataFrame:
    """(row, start, m, window): every occurrence of a window."""
    hits = places.where("pos IS NOT NULL")
    counts = hits.groupBy("h").agg(F.count("*").alias("n"))
    rated = shingles.join(counts, "h", "left")
    rarest = rated.groupBy("window", "m", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "h")).alias("s")).where("s.n > 0")
    prefix = rarest.select("window", "m", F.col("k").alias("pk"), "s.offset", "s.h")
    found = hits.join(prefix, "h").where("k = pk").withColumn("start", F.col("pos") - F.col("offset"))
    fits = found.where((F.col("start") >= 0) & (F.col("start") + F.col("m") <= F.col("n_words")))
    same = F.array_join(F.slice("near", F.col("before") - F.col("offset") + 1, F.col("m")), " ") == F.col("window")
    return fits.where(same).select("row", "start", "m", "window")


def _covered(places: Column) -> Column:
    """Words that intervals (start, m) cover together."""

    def grow(acc: Column, x: Column) -> Column:
        end = x["start"] + x["m"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(x["start"], acc["end"]))).alias("n"))

    return F.aggregate(F.array_sort(places), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), grow, lambda acc: acc["n"].cast("long"))


def _searched(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, occurrences, windows by item), all written."""
    of_item = materialise(windows(items, item_id, item_text, window))
    shingles = materialise(_shingles(of_item.select("window", "m").distinct()))
    places = materialise(_places(docs, shingles, id_col, text_col, window))
    return places, materialise(_verified(places, shingles)), of_item


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, start, m, window): where windows occur, in words from 0; documents with one id aren't told apart."""
    places, found, _ = _searched(docs, items, id_col, text_col, item_id, item_text, window)
    named = places.where("j = 0").select("row", F.col("id").alias(id_col))
    return named.join(found, "row").drop("row")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated), one row per document; items: ids as sorted strings."""
    places, found, of_item = _searched(docs, items, id_col, text_col, item_id, item_text, window)
    hit = found.groupBy("row").agg(_covered(F.collect_list(F.struct("start", "m"))).alias("n_hit"))
    pairs = found.select("row", "window").distinct().join(of_item.select("window", "item"), "window").select("row", "item").distinct()
    named = pairs.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    base = places.where("j IS NULL OR j = 0").select("row", "id", "n_words")
    out = base.join(hit.join(named, "row"), "row", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"), (n_hit > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM b, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS t(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT m FROM s),
p AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM w, k, unnest(generate_series(1, len(w) - m + 1)) AS t(i) WHERE len(w) >= m),
f AS (SELECT p.rid, p.i, p.m, s.item_id FROM p JOIN s ON p.win = s.win AND p.m = s.m),
h AS (SELECT rid, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS q FROM (SELECT DISTINCT rid, i, m FROM f)) GROUP BY rid),
n AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, coalesce(item_id::VARCHAR, '') AS item FROM f) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""
