"""N-gram Jaccard join by T-occurrence search (DivideSkip), exact, for components of links.

Texts become sets of hashed word shingles; equal sets are one class. Two sets link when
100 * intersection >= limit * union. The plan:

1. Count all shingles, in blocks by hash range (sorted arrays; no row per shingle). Those of at least
   HEAVY texts are heavy. Any fixed order of shingles gives an exact prefix filter, so the
   heavy list may be cut to MAX_HEAVY entries (it is broadcast) without loss.
2. In the order "light by hash, then heavy by count", sets that link share ``SHARED`` shingles
   of their prefixes. Light lists are short: their pairs are counted, and pairs with enough common
   prefix shingles must pass a bound from bucket counts of the whole sets. Classes
   that share a heavy prefix shingle are tied to the list's smallest class (a star).
3. Components of these candidate ties are small neighbourhoods that hold every link. Their whole sets go to
   one task, or to pairs of blocks when there are more than BLOCK of them. There DivideSkip
   finds links: short inverted lists are merged, the longest are only probed by binary search
   for what has occurred often enough. Pairs known to be connected are not verified again.
4. Spanning edges found are joined into the components; copies get their class's.

Null, blank or wordless texts have the empty set and link with nothing. Rows that repeat
are members of one class, also under different ids; rows that share an id but not a text are kept apart. A null id takes part, links and
bridges, but never names a component (a component of null ids only is null). Very long texts count with all their shingles; ties
(sets of equal size, lists of equal length) are broken by hash and change no result. An empty table gives an empty result; other
columns are not read, so they cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import connected_components, lean, materialise, ship_package

WORDS, LIMIT = 4, 85
HEAVY, MAX_HEAVY, LONG, SHARED, BUCKETS, BLOCK = 16, 1_000_000, 64, 3, 256, 1024
#: Shingles are dealt to 2 ** bits parts by their upper bits, at least and at most so many bits, and about so many rows a part; 32 more bits name them there.
PART_BITS, PART_ROWS = (9, 16), 8000
_MU = 0.02


def needed(n: np.ndarray | int, limit: int) -> np.ndarray | int:
    """Least intersection with any set that links, ceil(limit * n / 100)."""
    return -(-limit * n // 100)


def part_bits(rows: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(rows / PART_ROWS, 1))), *PART_BITS))


def _cuts(rising: np.ndarray, bits: int) -> np.ndarray:
    """Where each part begins in rising shingles, and the end."""
    return np.searchsorted(rising >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def set_classes(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; equal sets have equal names."""
    if not len(flat):
        return W.mix64(sizes.astype(np.uint64)).view(np.int64)
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix64(flat + np.uint64(0x51ED2701)), dtype=np.uint64)))
    x = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(W.mix64(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)))))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    return W.mix64(W.mix64(c[ends] - c[begins]) + (x[ends] ^ x[begins]) + sizes.astype(np.uint64)).view(np.int64)


def _first_of_class(cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    first = np.zeros(len(cls), bool)
    first[np.unique(cls, return_index=True)[1]] = True
    return first & (sizes > 0)


def _rows(height: int, **cols) -> pa.RecordBatch:
    """A batch of the common layout; columns not given are null."""
    types = {"kind": pa.int32(), "part": pa.int32(), "a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "blob": pa.binary()}
    arrays = [pa.array(cols[k], t) if k in cols else pa.nulls(height, t) for k, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, list(types))


_LAYOUT = "kind int, part int, a bigint, b bigint, n bigint, blob binary"


def _counting(k: int, bits: int):
    """Per text its class (kind 0); per slice and hash range the shingles of its classes (kind 1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, 1):
                flat, sizes = W.shingle_sets(b.column(1), k)
                cls = set_classes(flat, sizes)
                rows = b.num_rows
                yield _rows(rows, kind=np.zeros(rows, np.int32), a=b.column(0), b=cls, n=sizes)
                mine = np.sort(flat[np.repeat(_first_of_class(cls, sizes), sizes)])
                cut = _cuts(mine, bits)
                low = (mine >> np.uint64(32 - bits)).astype(np.uint32)
                parts = np.flatnonzero(np.diff(cut)).astype(np.int32)
                yield _rows(len(parts), kind=np.ones(len(parts), np.int32), part=parts, blob=[low[cut[p] : cut[p + 1]].tobytes() for p in parts])

    return work


def _heavy_of_part(t: pa.Table) -> pa.Table:
    part = t.column("part")[0].as_py()
    low = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("blob").to_pylist()]))
    cut = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1], [True])))
    count = np.diff(cut)
    on = count >= HEAVY
    key = (np.int64(part) << 32) + low[cut[:-1]][on].astype(np.int64)
    return pa.table({"key": key, "df": count[on].astype(np.int64)})


def _posting(k: int, limit: int, bits: int, heavy):
    """Prefix postings: light ones in blocks by hash range (kind 0), heavy ones as rows (kind 1); bucket counts of sets (kind 2)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, dfs = heavy.value
        for whole in batches:
            for b in W.slices(whole, 1):
                flat, sizes = W.shingle_sets(b.column(1), k)
                cls = set_classes(flat, sizes)
                use = _first_of_class(cls, sizes) & (100 * sizes >= limit * (sizes + 1))  # others link with equal sets only
                flat, cls, sizes = flat[np.repeat(use, sizes)], cls[use], sizes[use]
                if not len(sizes):
                    continue
                want = np.minimum(sizes - needed(sizes, limit) + SHARED, sizes)
                begin = np.cumsum(sizes) - sizes
                set_of = np.repeat(np.arange(len(sizes)), sizes)
                key = (flat >> np.uint64(32 - bits)).astype(np.int64)
                at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                big = keys[at] == key if len(keys) else np.zeros(len(flat), bool)
                light = np.cumsum(~big)
                rank = light - 1 - np.concatenate(([0], light))[begin][set_of]
                take = ~big & (rank < want[set_of])
                h, s = flat[take], set_of[take]
                order = np.argsort(h)
                h, s = h[order], s[order]
                cut = _cuts(h, bits)
                rec = np.empty(len(h), [("h", np.uint64), ("c", np.int64), ("n", np.uint32)])
                rec["h"], rec["c"], rec["n"] = h, cls[s], sizes[s]
                parts = np.flatnonzero(np.diff(cut)).astype(np.int32)
                yield _rows(len(parts), kind=np.zeros(len(parts), np.int32), part=parts, blob=[rec[cut[p] : cut[p + 1]].tobytes() for p in parts])
                lights = np.bincount(set_of[~big], minlength=len(sizes))
                hh, hc = [], []
                for i in np.flatnonzero(lights < want):
                    span = slice(begin[i], begin[i] + sizes[i])
                    mine, df = flat[span][big[span]], dfs[at[span]][big[span]]
                    pick = mine[np.lexsort((mine, df))[: want[i] - lights[i]]]
                    hh.append(pick)
                    hc.append(np.full(len(pick), cls[i]))
                if hh:
                    hh, hc = np.concatenate(hh), np.concatenate(hc)
                    yield _rows(len(hh), kind=np.ones(len(hh), np.int32), part=(hc & ((1 << bits) - 1)).astype(np.int32), a=hh.view(np.int64), b=hc)
                count = np.bincount(set_of * BUCKETS + (flat & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=len(sizes) * BUCKETS).reshape(-1, BUCKETS)
                blobs = [b"" if full else row.tobytes() for full, row in zip((count > 255).any(1).tolist(), count.astype(np.uint8), strict=True)]
                yield _rows(len(sizes), kind=np.full(len(sizes), 2, np.int32), part=(cls & ((1 << bits) - 1)).astype(np.int32), a=cls, n=sizes, blob=blobs)

    return work


def _pairing(limit: int):
    """Pairs of classes on short lists with how often they meet (kind 0); the rest passes."""

    def work(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        rest = t.filter(pa.array(kind != 0)).drop_columns(["blob"]).append_column("blob", t.filter(pa.array(kind != 0)).column("blob"))
        blobs = t.filter(pa.array(kind == 0)).column("blob").to_pylist()
        out = [rest]
        if blobs:
            rec = np.frombuffer(b"".join(blobs), [("h", np.uint64), ("c", np.int64), ("n", np.uint32)])
            order = np.lexsort((rec["c"], rec["h"]))
            h, c, n = rec["h"][order], rec["c"][order], rec["n"][order].astype(np.int64)
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
            h, c, n = h[fresh], c[fresh], n[fresh]
            cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            size = np.diff(cut)
            pa_, pb_ = [], []
            for m in np.unique(size[(size > 1) & (size <= LONG)]):
                first = cut[:-1][size == m]
                i, j = np.triu_indices(m, 1)
                x, y = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                ok = 100 * np.minimum(n[x], n[y]) >= limit * np.maximum(n[x], n[y])
                pa_.append(c[x[ok]])
                pb_.append(c[y[ok]])
            if pa_ and sum(map(len, pa_)):
                a, b = np.concatenate(pa_), np.concatenate(pb_)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                cut2 = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True])))
                times = np.diff(cut2)
                out.append(pa.Table.from_batches([_rows(len(times), kind=np.zeros(len(times), np.int32), a=a[cut2[:-1]], b=b[cut2[:-1]], n=times)]))
            far = np.repeat(size > LONG, size)
            if far.any():
                out.append(pa.Table.from_batches([_rows(int(far.sum()), kind=np.ones(int(far.sum()), np.int32), a=h[far].view(np.int64), b=c[far])]))
        return pa.concat_tables([x.select(["kind", "part", "a", "b", "n", "blob"]) for x in out])

    return work


def _bounding(limit: int):
    """Keeps pairs (a, b, na, nb, sa, sb) whose bucket counts allow a link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            keep = np.ones(b.num_rows, bool)
            sa, sb = b.column(4).to_pylist(), b.column(5).to_pylist()
            rows = [i for i in range(b.num_rows) if sa[i] and sb[i]]
            if rows:
                x = np.frombuffer(b"".join(sa[i] for i in rows), np.uint8).reshape(-1, BUCKETS)
                y = np.frombuffer(b"".join(sb[i] for i in rows), np.uint8).reshape(-1, BUCKETS)
                most = np.minimum(x, y).sum(1, dtype=np.int64)
                keep[rows] = (100 + limit) * most >= limit * (na + nb)[rows]
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return work


def merge_lists(lists: list[np.ndarray], least: int) -> np.ndarray:
    """Members of at least ``least`` of the sorted lists: a heap merge, or a merge sort of the runs when they hold more than 48."""
    total = sum(map(len, lists))
    if not total:
        return np.zeros(0, np.int64)
    if total > 48:
        x = np.sort(np.concatenate(lists), kind="stable")  # finds the sorted runs and merges them
        cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
        return x[cut[:-1]][np.diff(cut) >= least]
    out, last, times = [], -1, 0
    for v in heapq.merge(*[x.tolist() for x in lists]):
        times = times + 1 if v == last else 1
        last = v
        if times == least:
            out.append(v)
    return np.array(out, np.int64)


def divide_skip(sets: list[np.ndarray], limit: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges of all links between the sets (between the sides only, where given)."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.lexsort((owner, flat))
    token = flat[order]
    cut = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
    length = np.diff(cut)
    list_of = np.empty(len(flat), np.int64)
    list_of[order] = np.repeat(np.arange(len(length)), length)
    posting = owner[order]
    begin = np.cumsum(size) - size
    parent = np.arange(m)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    shared = np.bincount(owner, weights=(length[list_of] > 1), minlength=m)
    edges = []
    root = np.arange(m)
    for i in np.lexsort((np.arange(m), -shared / np.maximum(size, 1))).tolist():  # the most typical first: they connect most
        mine = list_of[begin[i] : begin[i] + size[i]]
        mine = mine[length[mine] > 1]
        t = int(needed(int(size[i]), limit))
        if len(mine) < t:
            continue
        mine = mine[np.argsort(length[mine], kind="stable")]
        long = min(t - 1, int(t / (_MU * np.log2(length[mine[-1]] + 1) + 1)))
        short, rest = mine[: len(mine) - long], mine[len(mine) - long :]
        cand = merge_lists([posting[cut[x] : cut[x + 1]] for x in short.tolist()], t - long)
        ok = (cand != i) & (100 * np.minimum(size[cand], size[i]) >= limit * np.maximum(size[cand], size[i]))
        if side is not None:
            ok &= side[cand] != side[i]
        cand = cand[ok]
        cand = cand[root[cand] != root[i]]
        if not len(cand):
            continue
        have = np.zeros(len(cand), np.int64)
        for x in mine.tolist():  # binary probes; the short lists' exact counts come the same way
            p = posting[cut[x] : cut[x + 1]]
            at = np.searchsorted(p, cand)
            have += p[np.minimum(at, len(p) - 1)] == cand
        found = cand[(100 + limit) * have >= limit * (size[cand] + size[i])].tolist()
        for j in found:
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((i, j))
        if found:
            root = parent[parent]
            while (step := root[root]).tolist() != root.tolist():
                root = step
    return edges


def _joining(limit: int):
    """Links inside every (component, block pair) of the group, as spanning edges between classes."""

    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        comp, p, q, side, cls = (t.column(c).to_numpy() for c in ("comp", "p", "q", "side", "cls"))
        order = np.lexsort((cls, side, q, p, comp))
        comp, p, q, side, cls = comp[order], p[order], q[order], side[order], cls[order]
        blob = t.column("blob").combine_chunks().take(pa.array(order))
        cut = np.flatnonzero(np.concatenate(([True], (comp[1:] != comp[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), [True])))
        ea, eb = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            fresh = a + np.flatnonzero(np.concatenate(([True], (cls[a + 1 : b] != cls[a : b - 1]))))
            if len(fresh) < 2:
                continue
            sets = [np.frombuffer(blob[int(i)].as_py(), np.uint64) for i in fresh]
            for i, j in divide_skip(sets, limit, None if p[a] == q[a] else side[fresh]):
                ea.append(cls[fresh[i]])
                eb.append(cls[fresh[j]])
        return pa.table({"a": pa.array(ea, pa.int64()), "b": pa.array(eb, pa.int64())})

    return work


def _sets_of_nameless(k: int):
    """(cls, blob) of texts without an id, once for each class of a slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, 0):
                flat, sizes = W.shingle_sets(b.column(0), k)
                cls = set_classes(flat, sizes)
                end, on = np.cumsum(sizes), np.flatnonzero(_first_of_class(cls, sizes))
                yield pa.RecordBatch.from_arrays([pa.array(cls[on]), pa.array([flat[end[i] - sizes[i] : end[i]].tobytes() for i in on], pa.binary())], ["cls", "blob"])

    return work


def _sets_of_wanted(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, 0):
                flat, sizes = W.shingle_sets(b.column(0), k)
                same = set_classes(flat, sizes) == b.column(1).to_numpy()
                end = np.cumsum(sizes)
                blobs = [flat[e - s : e].tobytes() for e, s, ok in zip(end.tolist(), sizes.tolist(), same.tolist(), strict=True) if ok]
                ok = pa.array(same)
                yield pa.RecordBatch.from_arrays([*(b.column(i).filter(ok) for i in (1, 2, 3)), pa.array(blobs, pa.binary())], ["cls", "comp", "blocks", "blob"])

    return work


def components(docs: DataFrame, words: int = WORDS, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per input row."""
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bits = part_bits(src.count())
    both = materialise(src.mapInArrow(lean(_counting(words, bits)), _LAYOUT))
    members = both.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("cls"), F.col("n").alias("n_shingles"))
    heavy = both.where("kind = 1").select("part", "blob").groupBy("part").applyInArrow(_heavy_of_part, "key bigint, df bigint")
    top = heavy.orderBy(F.desc("df"), "key").limit(MAX_HEAVY).toArrow()
    key, df = top.column("key").to_numpy(), top.column("df").to_numpy()
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], df[order]))

    paired = materialise(src.mapInArrow(lean(_posting(words, limit, bits, shared)), _LAYOUT).groupBy("part").applyInArrow(_pairing(limit), _LAYOUT))
    pairs = paired.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARED)
    sigs = paired.where("kind = 2").groupBy("a").agg(F.first("n").alias("n"), F.first("blob").alias("sig"))
    left, right = sigs.toDF("a", "na", "sa"), sigs.toDF("b", "nb", "sb")
    close = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_bounding(limit), "a bigint, b bigint")
    lists = paired.where("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("c"))
    stars = lists.join(lists.groupBy("h").agg(F.min("c").alias("m")), "h").where("c <> m").select(F.col("c").alias("a"), F.col("m").alias("b")).distinct()
    near = materialise(connected_components(close.unionAll(stars)))

    many = near.groupBy("component").agg(F.count("*").alias("size"))
    reps = members.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("rep"))
    wanted = near.join(many, "component").join(reps, F.col("node") == F.col("cls"))
    wanted = wanted.select("rep", "cls", F.col("component").alias("comp"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    texts = src.join(wanted, src["id"] == wanted["rep"]).select("text", "cls", "comp", "blocks")
    sets = texts.mapInArrow(lean(_sets_of_wanted(words)), "cls bigint, comp bigint, blocks int, blob binary")
    # a class whose rows have no id is read from those rows: null ids are pruned by the files' statistics where there are none
    nameless = src.where("id is null").select("text").mapInArrow(lean(_sets_of_nameless(words)), "cls bigint, blob binary").dropDuplicates(["cls"])
    sets = sets.unionByName(nameless.join(wanted.where("rep is null").select("cls", "comp", "blocks"), "cls"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), (F.col("own") > F.col("o")).cast("int").alias("side"), "cls", "blob")
    groups = max(1, near.count() // 256)
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("comp", "p", "q"), F.lit(groups)))
    links = dealt.groupBy("g").applyInArrow(_joining(limit), "a bigint, b bigint")
    joined = connected_components(links).withColumnRenamed("node", "cls")

    named = members.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("rep")).join(joined, "cls", "left").withColumn("root", F.coalesce("component", "cls"))
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = named.select("cls", "root").join(low, "root").select("cls", "component_id")
    out = members.join(ids, "cls", "left")
    comp = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
