r"""Source divergence audit: how far the smoothed term frequencies of each (language, source) lie from those of the others.

A language keeps the terms of at least LEAST_DOCS of its documents. A group's weight of a kept term is 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)),
and two groups' distance is the sum of f = |weight - weight| over all kept terms, those that neither holds too.

Distances come from joint count histograms. f depends on a term only through its two counts, so for each pair of sources the distinct (count, count)
combinations are tallied, and f is evaluated once per combination, times how many terms have it. Only terms that both hold are looked at in pairs,
inside tasks, which emit tallies. Cells with a zero are implied: the terms of one source with some count, from its own histogram, less those in the
pair's tally; (0, 0) is what is left of V. Counting is done per batch of texts before the first shuffle, so a hot source or language arrives as one row per batch and term.

Null text, language and source are ''. A group without terms, or a language without kept terms, still gives its pairs (distance 0 where V = 0).
Very long texts are read whole; a term counts once per document for LEAST_DOCS, whatever its repeats; repeated rows are documents of their own, ids are never read.
Ties rank by name, in order of UTF-8 bytes. An empty table gives an empty result; only text, language and source are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialise, ship_package
from .words import distinct, lower_ascii, slices, span_strings, text_bytes, word_spans

#: Documents of a language that a term needs, the weights' scale and smoothing, ranks of terms.
LEAST_DOCS, SCALE, SMOOTH, TOP = 30, 1_000_000_000, 5, 50
#: Bytes that part terms: all of ASCII but letters.
GAPS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
#: Bytes of text whose counts a task puts together before it emits them, and pairs of counts that it tallies at once.
COUNTED, TALLIED = 32 << 20, 1 << 21

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_JOINT = "lang string, a string, b string, ca bigint, cb bigint, m bigint"


def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of some documents; a group's row without a term says that it occurs."""
    data, off = text_bytes(batch.column(0))
    data = lower_ascii(data)
    start, end, per = word_spans(data, off, GAPS)
    term, names = distinct(span_strings(data, start, end))
    groups = pa.Table.from_arrays([batch.column(1), batch.column(2)], ["lang", "source"])
    known = groups.group_by(["lang", "source"]).aggregate([])
    place = {(r["lang"], r["source"]): i for i, r in enumerate(known.to_pylist())}
    group = np.array([place[x] for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64)
    wide = max(len(names), 1)
    in_doc = np.unique(np.repeat(np.arange(len(per)), per) * wide + term, return_counts=True)
    cell, at = np.unique(group[in_doc[0] // wide] * wide + in_doc[0] % wide, return_inverse=True)
    n, docs = np.bincount(at, in_doc[1], len(cell)).astype(np.int64), np.bincount(at, minlength=len(cell))
    lang, source = known.column("lang").combine_chunks(), known.column("source").combine_chunks()
    which = pa.array(np.concatenate([cell // wide, np.arange(len(lang))]))
    none = np.zeros(len(lang), np.int64)
    term_of = pa.array(np.concatenate([cell % wide, none]), mask=np.arange(len(which)) >= len(cell))
    return pa.table({"lang": lang.take(which), "source": source.take(which), "term": names.cast(pa.string()).take(term_of), "n": np.concatenate([n, none]), "docs": np.concatenate([docs, none])})


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0

    def merged() -> Iterator[pa.RecordBatch]:
        whole = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        yield from whole.rename_columns(["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        for part in slices(batch, 0):
            held.append(count_terms(part))
            size += part.column(0).nbytes
            if size >= COUNTED:
                yield from merged()
                held, size = [], 0
    if held:
        yield from merged()


def tally_pairs(lang: pa.Array, cells: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """Tallies of the combinations of counts that two sources have in the same terms; each term's cells are in order of source."""
    size = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = cells.flatten()
    n = flat.field("n").to_numpy(zero_copy_only=False)
    source, langs = flat.field("source").dictionary_encode(), lang.dictionary_encode()
    code, l_code = source.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(row)) - 1  # cells after this one in its term
    seen, rank = np.unique(n, return_inverse=True)
    wide, many = len(seen), len(source.dictionary)
    keys: list[np.ndarray] = []

    def emit() -> Iterator[pa.RecordBatch]:
        got = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
        m = np.bincount(got[1], np.concatenate([x for _, x in keys]), len(got[0])).astype(np.int64)
        rest, cb = np.divmod(got[0], wide)
        rest, ca = np.divmod(rest, wide)
        rest, b = np.divmod(rest, many)
        of, a = np.divmod(rest, many)
        names = [langs.dictionary.take(pa.array(of)), source.dictionary.take(pa.array(a)), source.dictionary.take(pa.array(b))]
        yield pa.RecordBatch.from_arrays([*names, pa.array(seen[ca]), pa.array(seen[cb]), pa.array(m)], names=["lang", "a", "b", "ca", "cb", "m"])

    held = 0
    for d in range(1, int(size.max(initial=0))):
        at = np.flatnonzero(left >= d)
        for part in np.array_split(at, len(at) // TALLIED + 1):
            key = ((l_code[row[part]] * many + code[part]) * many + code[part + d]) * wide * wide + rank[part] * wide + rank[part + d]
            keys.append(np.unique(key, return_counts=True))
            held += len(keys[-1][0])
            if held >= TALLIED:
                yield from emit()
                keys, held = [], 0
    if keys:
        yield from emit()


def _tallying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from tally_pairs(batch.column(0), batch.column(1))


def _weight(count: str, total: str, terms: str) -> Column:
    """Exact, whatever the counts: whole-number division of decimals."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + {SMOOTH} AS DECIMAL(20, 0))) div CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20, 0))")


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) over all documents, with a row without a term for each group."""
    ship_package(docs.sparkSession)
    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    return src.mapInArrow(lean(_counting), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def joint_histograms(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, m), a < b: how many kept terms have these counts in the two sources, zeros included."""
    joint = terms.select("lang", "cells").mapInArrow(lean(_tallying), _JOINT)
    own = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source"), F.col("c.n").alias("c")).agg(F.count("*").alias("m"))
    held = own.groupBy("lang", "source").agg(F.sum("m").alias("held"))
    sides = groups.join(held, ["lang", "source"], "left").select("lang", "source", "v", F.coalesce("held", F.lit(0)).alias("held"))
    a, b = (sides.select("lang", F.col("source").alias(s), F.col("held").alias(f"held_{s}"), "v") for s in "ab")
    pairs = a.join(b.drop("v"), "lang").where("a < b")
    zero = F.lit(0).cast("long")

    def implied(side: str, ca: Column, cb: Column) -> DataFrame:
        return pairs.select("lang", "a", "b").join(own.withColumnRenamed("source", side), ["lang", side]).select("lang", "a", "b", ca.alias("ca"), cb.alias("cb"), "m")

    # a term in both sources is in both own histograms: it is taken from the cells with a zero again
    moved = F.array(*[F.struct(x.alias("ca"), y.alias("cb"), (F.col("m") * s).alias("m")) for x, y, s in ((F.col("ca"), F.col("cb"), 1), (F.col("ca"), zero, -1), (zero, F.col("cb"), -1), (zero, zero, 1))])
    both = joint.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).select("lang", "a", "b", F.inline(moved))
    rest = pairs.select("lang", "a", "b", zero.alias("ca"), zero.alias("cb"), (F.col("v") - F.col("held_a") - F.col("held_b")).alias("m"))
    whole = both.unionByName(implied("a", F.col("c"), zero)).unionByName(implied("b", zero, F.col("c"))).unionByName(rest)
    return whole.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to every other source of the language, and the terms most above the language's weight."""
    counts = materialise(counted(docs, text_col, lang_col, source_col))
    cells = F.array_sort(F.collect_list(F.struct("source", "n")))
    terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), cells.alias("cells")).where(F.col("docs") >= least_docs)
    terms = materialise(terms.select("lang", "term", "n", "cells"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_lang"))
    of_group = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "total"])
    groups = materialise(groups)

    def of(side: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(side), F.col("total").alias(f"n_{side}"))

    histograms = joint_histograms(terms, groups).where("m <> 0").join(of("a"), ["lang", "a"]).join(groups.select("lang", F.col("source").alias("b"), F.col("total").alias("n_b"), "v"), ["lang", "b"])
    f = F.abs(_weight("ca", "n_a", "v") - _weight("cb", "n_b", "v"))
    distance = histograms.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * f).alias("value"))
    pairs = of("a").drop("n_a").join(of("b").drop("n_b"), "lang").where("a < b").join(distance, ["lang", "a", "b"], "left").na.fill(0, ["value"])
    ways = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])
    pairs = pairs.select("lang", F.inline(ways), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    each = terms.select("lang", F.col("term").alias("item"), F.col("n").alias("c_lang"), F.explode("cells").alias("c")).select("lang", "item", "c_lang", F.col("c.source").alias("source"), F.col("c.n").alias("c"))
    above = each.join(groups, ["lang", "source"]).withColumn("value", _weight("c", "total", "v") - _weight("c_lang", "n_lang", "v")).where("value > 0")
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(above.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY lang, source),
p AS (SELECT x.lang, x.source, term, x.n, 1 + (1000000000::HUGEINT * (x.n + 5)) // (total + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (x.n_lang + 5)) // (l.n + 5 * v)::HUGEINT AS q
  FROM x JOIN s ON x.lang = s.lang AND x.source = s.source JOIN l ON x.lang = l.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
o AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM e UNION ALL SELECT * FROM o)) WHERE part = 'pair' OR rank <= 50
"""
