"""Best-fit-decreasing packing of token pieces into sequences of a fixed capacity.

Documents become token ids and an end id. A document over the capacity is cut; only
its first piece is then shorter than the capacity. Best-fit decreasing depends on
nothing but how many pieces have each length, and there are at most ``capacity`` lengths.
So the plan is made on that histogram: lengths in falling order, and a segment tree over
remaining capacities whose leaf ``c`` holds the open bins with ``c`` tokens left. The
tightest bin is found in O(log capacity). Bins alike go together as ranges, giving exactly
what the loop over single documents gives. Pieces then learn their bin from their rank
among the pieces of their length. The plan's size depends on the capacity only,
never on the rows, so it may be broadcast.

A null text counts as empty (its end id alone). Very long texts are encoded whole and cut into pieces; pieces of one length
rank by a hash of their row, so ties are settled alike in every run on the same files. Rows that repeat, also with equal or null
ids, are all packed. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import lean, materialise, ship_package

CAPACITY, END_ID = 1024, 2
#: A worker keeps the ids of so many units, or so many bytes of units, over slices and tasks; then it begins anew.
CACHE_UNITS, CACHE_BYTES = 600_000, 24 << 20
#: Buckets of ranks that one window orders.
WIDE = 4096
_CACHE: dict = {}


def byte_alphabet() -> list[str]:
    """Printable stand-ins for the 256 bytes: printable ones stand for themselves, others follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def other_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are the last one of a white space character outside ASCII."""
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    last, mid = data[1:], data[:-1]
    out[1:] = (mid == 0xC2) & ((last == 0x85) | (last == 0xA0))
    first, mid, last = data[:-2], data[1:-1], data[2:]
    out[2:] |= (first == 0xE1) & (mid == 0x9A) & (last == 0x80) | (first == 0xE3) & (mid == 0x80) & (last == 0x80)
    general = (last >= 0x80) & (last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF)
    out[2:] |= (first == 0xE2) & ((mid == 0x80) & general | (mid == 0x81) & (last == 0x9F))
    return out


class UnitEncoder:
    """Token ids by white-space-led units; a distinct unit is encoded once per worker.

    A unit begins at ASCII white space after something that isn't white space of any kind, so that
    tokens never cross units. New units are encoded as one string; as the number of bytes of every token is known, running
    byte counts tell where each unit's ids end. Units whose ends would meet their neighbours' white space in that string go by themselves.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for s, i in vocab.items():
            self.bytes_of[i] = len(s.encode()) if s in special else len(s)
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> UnitEncoder:
        if path not in _CACHE:
            _CACHE[path] = cls(path)
        return _CACHE[path]

    def ids(self, raw: bytes) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids, np.uint32)  # ids without offsets

    def _learn(self, fresh: pa.Array) -> None:
        off = np.frombuffer(fresh.buffers()[1], np.int64)[: len(fresh) + 1]
        data = np.frombuffer(fresh.buffers()[2], np.uint8)[: off[-1]]
        other = other_space(data)
        head = data[off[:-1]]
        width = np.where(head == 0xC2, 1, np.where((head >= 0xE1) & (head <= 0xE3), 2, 0))
        alone = W.is_space(data[off[1:] - 1]) | other[off[1:] - 1] | (width > 0) & other[np.minimum(off[:-1] + width, len(data) - 1)]
        led = W.is_space(head)  # others are a text's first unit: a line end goes before them
        plain, first, rest = (fresh.filter(pa.array(x)) for x in (~alone & led, ~alone & ~led, alone))
        if len(plain):
            o = np.frombuffer(plain.buffers()[1], np.int64)[: len(plain) + 1]
            ids = self.ids(plain.buffers()[2].to_pybytes()[: o[-1]])
            self._keep(plain, ids, np.searchsorted(np.cumsum(self.bytes_of[ids]), o[1:], side="left") + 1)
        if len(first):
            lines = [b"\n" + u for u in first.to_pylist()]
            ids = self.ids(b"".join(lines))
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(u) for u in lines]), side="left") + 1
            self._keep(first, np.delete(ids, np.concatenate(([0], ends[:-1]))), ends - np.arange(1, len(lines) + 1))
        if len(rest):
            each = [self.ids(u) for u in rest.to_pylist()]
            self._keep(rest, np.concatenate(each), np.cumsum([len(x) for x in each]))

    def _keep(self, units: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, ends + self.starts[-1]))
        self.flat = np.concatenate((self.flat, ids))
        self.known = pa.concat_arrays([self.known, units])

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text)."""
        data, off = W.text_bytes(col)
        s, e, per = W.unit_spans(data, off)
        other = other_space(data)
        if other.any():  # white space may run on over a unit's beginning
            inner = np.ones(len(s), bool)
            inner[np.searchsorted(s, off[:-1][per > 0])] = False
            s = s[~(inner & other[s - 1])]
            e, per = np.append(s[1:], len(data)), np.diff(np.searchsorted(s, off))
        idx, vals = W.distinct(W.span_strings(data, s, e))
        if len(self.known) > CACHE_UNITS or self.known.nbytes > CACHE_BYTES:
            self.clear()
        at = pc.index_in(vals, value_set=self.known)
        if at.null_count:
            self._learn(vals.filter(pc.is_null(at)))
            at = pc.index_in(vals, value_set=self.known)
        at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        at = at[idx] if len(idx) else at
        cuts = np.concatenate(([0], np.cumsum(per)))
        sums = np.concatenate(([0], np.cumsum(self.starts[at + 1] - self.starts[at])))
        return W.ragged_take(self.flat, self.starts, at), np.diff(sums[cuts])


def cut_lengths(n: int, capacity: int) -> list[int]:
    if n <= capacity:
        return [n]
    head = n % capacity
    return ([head] if head else []) + [capacity] * (n // capacity)


class CapacityTree:
    """Segment tree over remaining capacities; a leaf holds ranges of bins with that much room."""

    def __init__(self, capacity: int):
        self.n = 1
        while self.n < capacity + 1:
            self.n *= 2
        self.live = [0] * (2 * self.n)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, first: int, count: int) -> None:
        if count:
            if not self.ranges[room]:
                self._add(room, 1)
            self.ranges[room].append((first, count))

    def pop(self, room: int) -> tuple[int, int]:
        x = self.ranges[room].pop()
        if not self.ranges[room]:
            self._add(room, -1)
        return x

    def _add(self, room: int, by: int) -> None:
        k = room + self.n
        while k:
            self.live[k] += by
            k //= 2

    def tightest(self, least: int) -> int | None:
        """Smallest capacity >= least that has an open bin."""
        k = least + self.n
        if self.live[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.live[k + 1]:
                k += 1
                while k < self.n:
                    k = 2 * k if self.live[2 * k] else 2 * k + 1
                return k - self.n
            k //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first bin, pieces per bin, offset in the bin)."""
    tree, out, bins = CapacityTree(capacity), [], 0
    for length in sorted((x for x, c in histogram.items() if c), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                first, have, room = bins, -(-left // per), capacity
                bins += have
            else:
                first, have = tree.pop(room)
            per = room // length
            full = min(have, left // per)
            if full:
                out.append((length, rank, rank + full * per, first, per, capacity - room))
                tree.push(room - per * length, first, full)
                rank, left, first, have = rank + full * per, left - full * per, first + full, have - full
            if have and left:  # fewer pieces than one more bin takes
                out.append((length, rank, rank + left, first, left, capacity - room))
                tree.push(room - left * length, first, 1)
                first, have, left = first + 1, have - 1, 0
            tree.push(room, first, have)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    ship_package(spark)
    id_type = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = UnitEncoder.of(tokenizer_path)
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for b in W.slices(whole, 1):
                ids, per = enc.encode(b.column(1))
                rows, piece, start, length, crc, at = [], [], [], [], [], 0
                for i, n in enumerate(per.tolist()):
                    mine = np.concatenate((ids[at : at + n], end)).astype("<u4")
                    at += n
                    begin = 0
                    for k, size in enumerate(cut_lengths(n + 1, capacity)):
                        rows.append(i)
                        piece.append(k)
                        start.append(begin)
                        length.append(size)
                        crc.append(zlib.crc32(mine[begin : begin + size]))
                        begin += size
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(cut), f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")
    pieces = materialise(pieces.withColumn("rid", F.monotonically_increasing_id()))
    rows = pieces.count()
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(max(64, rows // 1000))))
    counts = materialise(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    # pieces of one length before a bucket: within its run of WIDE buckets, and in the runs before
    runs = counts.withColumn("run", F.floor(F.col("bucket") / WIDE))
    earlier = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    whole = runs.groupBy("length", "run").agg(F.sum("n").alias("n")).select("length", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("whole"))
    before = Window.partitionBy("length", "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.withColumn("own", F.coalesce(F.sum("n").over(before), F.lit(0))).join(whole, ["length", "run"]).select("length", "bucket", (F.col("own") + F.col("whole")).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("rid")) - 1
    ranked = pieces.withColumn("local", local).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("local"))
    steps = plan(histogram, capacity)
    schema = "p_length bigint, r0 bigint, r1 bigint, bin0 bigint, per bigint, room_at bigint"
    table = spark.createDataFrame(steps, schema)  # size depends on the capacity alone
    joined = ranked.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")))
    k = F.col("rank") - F.col("r0")
    return joined.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("bin0") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("room_at") + F.pmod(k, F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("byte_bpe_50k.json"))
