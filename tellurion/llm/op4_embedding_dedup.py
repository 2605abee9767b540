"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

Each table applies pseudo-random rotations (sign flips and fast Walsh-Hadamard transforms, three
times) and keeps the signed axis nearest to the rotated vector, for two rotations at once: its
bucket. Multiprobe adds the buckets of the runner-up axes. Vectors that share a
bucket in any table are compared exactly (cosine in doubles), so no link is below the limit.

Equal vectors are one class with a weight. A bucket above BLOCK rows is dealt out to
pairs of blocks, so no group is ever gathered whole. A pair counts in the first
bucket where it meets, and leaves only sums and a spanning forest, not pairs, so the
output stays linear in the rows. Links within classes are counted by weight.

Null vectors, zero vectors and those with null or non-finite components, or without an id, link with
nothing and are their own component. Vectors of different length never meet; very long ones are compared whole. Repeated
rows count as further vectors, also where they share an id; rows of one id with different vectors are kept apart. Ties of axes go to the
lower axis. An empty table gives an empty result; other columns are not read, so they cannot clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialise, ship_package

TABLES, PROBES, AXES, BLOCK, GROUP_ROWS = 8, 4, 3, 512, 4000


def fast_hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (a power of two wide), unscaled."""
    x = x.copy()
    n, h = x.shape[1], 1
    while h < n:
        v = x.reshape(len(x), n // (2 * h), 2, h)
        a, b = v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]
        v[:, :, 0], v[:, :, 1] = a, b
        h *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = fast_hadamard(y * rng.choice([-1.0, 1.0], n)) / np.sqrt(n)
    return y


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers; the first is the home bucket.

    A bucket is AXES signed axes, one per rotation. Probes swap one or two of them for runners-up,
    the least loss of height first.
    """
    n = len(x)
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        axes, heights, wide = [], [], 1
        for part in range(AXES):
            y = rotate(x, 1000 * t + part)
            k = min(3, y.shape[1])
            best = np.argpartition(-np.abs(y), k - 1, axis=1)[:, :k]
            h = np.take_along_axis(y, best, 1)
            order = np.argsort(-np.abs(h), axis=1, kind="stable")
            best, h = np.take_along_axis(best, order, 1), np.take_along_axis(h, order, 1)
            axes.append((best * 2 + (h < 0)) * wide)
            heights.append(np.abs(h[:, :1]) - np.abs(h))
            wide *= 2 * y.shape[1]
        codes, loss = [], []
        for ranks in itertools.product(range(axes[0].shape[1]), repeat=AXES):
            if sum(r > 0 for r in ranks) <= 2:
                codes.append(sum(a[:, r] for a, r in zip(axes, ranks, strict=True)))
                loss.append(sum(h[:, r] for h, r in zip(heights, ranks, strict=True)))
        codes, loss = np.stack(codes, 1), np.stack(loss, 1)
        order = np.argsort(loss[:, 1:], axis=1, kind="stable")[:, :probes] + 1  # the first is the home bucket, without loss
        got = np.concatenate((codes[:, :1], np.take_along_axis(codes, order, 1)), 1)
        out[:, t] = np.concatenate((got, np.repeat(codes[:, :1], 1 + probes - got.shape[1], 1)), 1)
    return out


def _clean(values: pa.Array) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for v in values:
        x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore"):
            ok = x is not None and len(x) and v.values.null_count == 0 and np.isfinite(x).all() and np.any(x) and np.isfinite(x @ x) and x @ x > 0
        out.append(x + 0.0 if ok else None)
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in batches:
        raw = [None if x is None else x.tobytes() for x in _clean(b.column(1))]
        key = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "raw"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each class's bucket numbers (``codes``) and the distinct keys that it is filed under.

    A key holds table, code and the vector's length (modulo 256).
    """
    for b in batches:
        raw = b.column(2).to_pylist()
        by_size: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            by_size.setdefault(len(r), []).append(i)
        for size, rows in by_size.items():
            x = np.frombuffer(b"".join(raw[i] for i in rows), np.float64).reshape(len(rows), -1)
            codes = buckets(x / np.sqrt((x * x).sum(1, keepdims=True)))
            keys = np.sort((codes << 16) + ((size // 8 & 255) << 8) + np.arange(codes.shape[1])[None, :, None], axis=2).reshape(len(rows), -1)
            fresh = np.ones(keys.shape, bool)
            fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(fresh.sum(1)))), pa.int32()), pa.array(keys[fresh]))
            place = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(place) for k in range(3)), pa.array([c.tobytes() for c in codes], pa.binary()), lists], ["rep", "weight", "raw", "codes", "keys"])


def reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node that each of n nodes reaches over the edges (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


def _linker(limit: float):
    def link(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        bucket, p, q, side = (t.column(c).to_numpy() for c in ("bucket", "p", "q", "side"))
        order = np.lexsort((side, q, p, bucket))
        bucket, p, q, side = bucket[order], p[order], q[order], side[order]
        rep, weight = t.column("rep").to_numpy()[order], t.column("weight").to_numpy()[order]
        raw, codes = t.column("raw").take(pa.array(order)).to_pylist(), t.column("codes").take(pa.array(order)).to_pylist()
        wide = np.array([len(r) for r in raw])
        order = np.lexsort((side, wide, q, p, bucket))  # lengths that agree modulo 256 only are kept apart
        bucket, p, q, side, rep, weight, wide = (v[order] for v in (bucket, p, q, side, rep, weight, wide))
        raw, codes = [raw[i] for i in order], [codes[i] for i in order]
        cut = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]) | (wide[1:] != wide[:-1]), [True])))
        nodes, sums, ea, eb = [], [], [], []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a < 2:
                continue
            x = np.frombuffer(b"".join(raw[a:b]), np.float64).reshape(b - a, -1)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            table, here = int(bucket[a] & 255), int(bucket[a] >> 16)
            if p[a] == q[a]:
                i, j = np.nonzero(np.triu(x @ x.T >= limit, 1))
            else:
                m = int(np.searchsorted(side[a:b], 1))
                i, j = np.nonzero(x[:m] @ x[m:].T >= limit)
                j = j + m
            if not len(i):
                continue
            c = np.frombuffer(b"".join(codes[a:b]), np.int64).reshape(b - a, TABLES, -1)
            old = np.zeros(len(i), bool)  # met before, in an earlier table or a lower bucket of this one?
            for s in range(0, len(i), 65536):
                u, v = c[i[s : s + 65536], : table + 1], c[j[s : s + 65536], : table + 1]
                same = u[:, :, :, None] == v[:, :, None, :]
                same[:, table] &= u[:, table, :, None] < here
                old[s : s + 65536] = same.any((1, 2, 3))
            i, j = i[~old], j[~old]
            if not len(i):
                continue
            w = weight[a:b]
            got = np.bincount(i, w[j], b - a) + np.bincount(j, w[i], b - a)
            on = np.flatnonzero(got)
            nodes.append(rep[a:b][on])
            sums.append(got[on].astype(np.int64))
            root = reached(b - a, i, j)
            moved = np.flatnonzero(root != np.arange(b - a))
            ea.append(rep[a + moved])
            eb.append(rep[a + root[moved]])
        node = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        total = np.concatenate(sums) if sums else np.zeros(0, np.int64)
        ea, eb = (np.concatenate([np.zeros(0, np.int64), *e]) for e in (ea, eb))
        return pa.table({
            "node": pa.array(np.concatenate((node, ea))),
            "links": pa.array(np.concatenate((total, np.zeros(len(ea), np.int64)))),
            "other": pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(eb)]),
        })

    return link


def dedup(vectors: DataFrame, limit: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    ship_package(vectors.sparkSession)
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    rows = materialise(src.mapInArrow(_digests, "vec_id bigint, digest binary, raw binary"))
    able = rows.where("digest is not null and vec_id is not null")
    classes = able.groupBy("digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()))  # a class is known by a number, as ids may repeat
    hashed = materialise(classes.select("rep", "weight", "raw").mapInArrow(_hashed, "rep bigint, weight bigint, raw binary, codes binary, keys array<bigint>"))
    filed = hashed.select("rep", F.explode("keys").alias("bucket"))  # narrow rows; vectors join those that have company
    sizes = filed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(filed.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = shared.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "rep", F.least("own", "o").alias("p"), F.greatest("own", "o").alias("q"), (F.col("own") > F.col("o")).cast("int").alias("side"))
    dealt = dealt.join(hashed.select("rep", "weight", "raw", "codes"), "rep")
    groups = max(1, shared.count() // GROUP_ROWS)
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("bucket", "p", "q"), F.lit(groups)))
    found = materialise(dealt.groupBy("g").applyInArrow(_linker(limit), "node bigint, links bigint, other bigint"))
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    info = classes.select("digest", "rep", "low", "weight").join(links, F.col("rep") == F.col("node"), "left").drop("node")
    info = info.join(comps, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("component", "rep")).drop("component")
    names = info.groupBy("root").agg(F.min("low").alias("component"))
    info = info.join(names, "root").select("digest", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    one = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(info, "digest", "left")
    comp = F.coalesce("component", "vec_id")
    return one.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.cast("long").alias("component_id"), (F.col("vec_id") == comp).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
