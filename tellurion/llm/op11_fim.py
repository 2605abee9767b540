"""Fill-in-middle: a parallel automaton scan finds units, cuts and markers, in giant texts too.

An automaton over the bytes of UTF-8 knows where a unit (code point, word, line) begins and whether a marker has
occurred. Where a scan starts inside a text its state is unknown, so every block of bytes emits its transition
function (state on entry -> state on exit) with the number of units that begin in it for each state on entry.
Such functions compose associatively: a doubling scan over the blocks resolves the state on entry and the units before each.

Texts of up to CHUNK bytes are scanned where they lie. Longer ones are split into chunks that Spark spreads over
tasks; only the chunks' functions meet again (one row of some 40 bytes a chunk, at most 2^31 / CHUNK for a text). The cuts
are units chosen by hashes; each lies in a known chunk, whose bytes alone are searched from the resolved state.

Two cuts split a text into prefix, middle and suffix. The output joins them behind the markers, in one of two orders; ``restore``
rebuilds the text from output and form.

Null texts count as empty, null ids as the empty text; empty texts, and those that hold a marker, stay plain. Cuts may fall together,
which leaves parts empty. Rows are judged one by one, so repeated rows and ids fare alike; an empty table gives an empty result.
Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship_package
from .words import slices, text_bytes

#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 transformed ones so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes of a text that one task scans at most, and of a block within it.
CHUNK, BLOCK = 1 << 16, 256


@dataclass(frozen=True)
class Automaton:
    """classes: byte -> class; step, begins: (state, class) -> next state, and whether the byte begins a unit; found: states after a marker. State 0 is the first."""

    classes: np.ndarray
    step: np.ndarray
    begins: np.ndarray
    found: np.ndarray


Unit = tuple[list[list[int]], list[list[bool]]]


def code_points() -> Unit:
    return [[0] * 256], [[b & 0xC0 != 0x80 for b in range(256)]]


def words() -> Unit:
    """A word begins with a byte other than ASCII white space, after such or at the start; white space belongs to the word before."""
    blank = [b in b" \t\n\v\f\r" for b in range(256)]
    return [[int(not x) for x in blank]] * 2, [[not x for x in blank], [False] * 256]


def lines() -> Unit:
    after = [int(b != 10) for b in range(256)]
    return [after] * 2, [[True] * 256, [False] * 256]


def automaton(unit: Unit, markers: Sequence[str] = (PREFIX, SUFFIX, MIDDLE)) -> Automaton:
    """Product of a unit's automaton with the one that looks for markers, with the fewest states and classes."""
    wanted = [m.encode() for m in markers]
    heads = sorted({m[:i] for m in wanted for i in range(len(m))} | {b""}, key=len)

    def follow(head: bytes, byte: int) -> int:
        seen = head + bytes([byte])
        if any(seen.endswith(m) for m in wanted):
            return len(heads)
        return next(heads.index(seen[i:]) for i in range(len(seen) + 1) if seen[i:] in heads)

    mark = np.array([[follow(h, b) for b in range(256)] for h in heads] + [[len(heads)] * 256])
    u_step, u_begin = np.array(unit[0]), np.array(unit[1])
    n_u, n_m = len(u_step), len(mark)
    step = (u_step[:, None, :] * n_m + mark[None, :, :]).reshape(n_u * n_m, 256)
    begins = np.repeat(u_begin, n_m, axis=0)
    found = np.tile(np.arange(n_m) == n_m - 1, n_u)
    group = np.zeros(len(step), np.int64)
    while True:  # states with the same outputs and successors are one
        view = np.concatenate([group[:, None], found[:, None], begins, group[step]], axis=1)
        finer = np.unique(view, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = list(dict.fromkeys(group.tolist()))  # the first state stays 0
    first = [int(np.flatnonzero(group == g)[0]) for g in order]
    name = np.argsort(order)
    small, out = name[group[step[first]]], begins[first]
    _, at, classes = np.unique(np.concatenate([small, out], axis=0), axis=1, return_index=True, return_inverse=True)
    return Automaton(classes.ravel().astype(np.uint8), small[:, at].astype(np.uint8), out[:, at].astype(np.uint8), found[first])


# functions of blocks --------------------------------------------------------------


def blocks_of(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length) of the blocks of texts at offsets off, and their number for each text; an empty text has an empty block."""
    lens = np.diff(off)
    sizes = np.maximum(1, -(-lens // BLOCK))
    rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = np.repeat(off[:-1], sizes) + rank * BLOCK
    return start, np.minimum(np.repeat(off[1:], sizes) - start, BLOCK), sizes


def scan(auto: Automaton, kinds: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(next state, units begun) of each block for each state on entry; all blocks go forward together, byte by byte."""
    states, width = auto.step.shape
    order = np.argsort(-length, kind="stable")
    at, lens = start[order], length[order]
    state = np.tile(np.arange(states, dtype=np.intp), (len(order), 1))
    units = np.zeros((len(order), states), np.int64)
    step, begins = auto.step.ravel().astype(np.intp), auto.begins.ravel()
    live = np.searchsorted(-lens, -np.arange(1, BLOCK + 1), side="right")
    for t in range(int(lens[0]) if len(lens) else 0):
        k = live[t]
        cell = state[:k] * width + kinds[at[:k] + t][:, None]
        units[:k] += begins[cell]
        state[:k] = step[cell]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return state[back], units[back]


def prefixes(state: np.ndarray, units: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composition of every function with all before it in its group, by doubling."""
    state, units = state.copy(), units.copy()
    rank = np.arange(len(state)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    d = 1
    while len(sizes) and d < sizes.max():
        right = np.flatnonzero(rank >= d)
        via = state[right - d]
        units[right] = units[right - d] + np.take_along_axis(units[right], via, axis=1)
        state[right] = np.take_along_axis(state[right], via, axis=1)
        d *= 2
    return state, units


def entered(state: np.ndarray, units: np.ndarray, sizes: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state on entry, units before) of every block, from the prefixes and each group's own state on entry."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    rows, of = np.arange(len(group)), entry[group]
    into, before = np.roll(state[rows, of], 1), np.roll(units[rows, of], 1)
    heads = np.cumsum(sizes) - sizes
    into[heads], before[heads] = entry, 0
    return into, before


def find(auto: Automaton, kinds: np.ndarray, start: np.ndarray, length: np.ndarray, into: np.ndarray, before: np.ndarray, sizes: np.ndarray, group: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Byte at which unit target (from 0) of its group begins; each target must exist. Only the block that holds it is walked."""
    wide = int(before.max(initial=0)) + 2
    key = np.repeat(np.arange(len(sizes)), sizes) * wide + before
    block = np.searchsorted(key, group * wide + np.minimum(target, wide - 1), side="right") - 1
    at, left, state = start[block].copy(), target - before[block], into[block].copy()
    end, out = at + length[block], np.full(len(block), -1, np.int64)
    live = np.arange(len(block))
    while len(live):
        live = live[at[live] < end[live]]
        kind = kinds[at[live]]
        new = auto.begins[state[live], kind].astype(bool)
        hit = new & (left[live] == 0)
        out[live[hit]] = at[live[hit]]
        left[live] -= new
        state[live] = auto.step[state[live], kind]
        at[live] += 1
        live = live[~hit]
    return out


# the same in Spark ----------------------------------------------------------------


def _pieces(*columns: pa.Array):
    """The columns in runs of some MB of their first one's bytes, as (bytes, offsets, other columns)."""
    batch = pa.RecordBatch.from_arrays(list(columns), names=[str(i) for i in range(len(columns))])
    for part in slices(batch, 0):
        data, off = text_bytes(_as_text(part.column(0)))
        yield data, off, [c.to_numpy(zero_copy_only=False) for c in part.columns[1:]]


def _as_text(col: pa.Array) -> pa.Array:
    """Bytes under the type of texts, whether they are whole characters or not."""
    col = col.cast(pa.large_binary())
    return pa.Array.from_buffers(pa.large_string(), len(col), col.buffers(), offset=col.offset)


_CUTS = pa.struct([("n", pa.int64()), ("found", pa.bool_()), ("lo", pa.int64()), ("hi", pa.int64()), ("lo_at", pa.int64()), ("hi_at", pa.int64())])
_FUNCTION = pa.struct([("state", pa.list_(pa.int32())), ("units", pa.list_(pa.int64()))])
_RESOLVED = pa.struct([("n", pa.int64()), ("found", pa.bool_()), ("into", pa.list_(pa.int32())), ("before", pa.list_(pa.int64()))])


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)


def _cutter(auto: Automaton) -> Callable[..., Column]:
    """Units, marker and the bytes of both cuts of texts that one task scans whole."""

    @F.arrow_udf("n bigint, found boolean, lo bigint, hi bigint, lo_at bigint, hi_at bigint")
    def cut(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for data, off, (a_, b_) in _pieces(text, a, b):
            kinds = auto.classes[data]
            start, length, sizes = blocks_of(off)
            state, units = prefixes(*scan(auto, kinds, start, length), sizes)
            last = np.cumsum(sizes) - 1
            n, found = units[last, 0], auto.found[state[last, 0]]
            into, before = entered(state, units, sizes, np.zeros(len(sizes), np.int64))
            lo, hi = np.minimum(a_ % (n + 1), b_ % (n + 1)), np.maximum(a_ % (n + 1), b_ % (n + 1))
            size = np.diff(off)
            places = []
            for unit in (lo, hi):
                at, inside = size.copy(), np.flatnonzero(unit < n)
                at[inside] = find(auto, kinds, start, length, into, before, sizes, inside, unit[inside]) - off[inside]
                places.append(at)
            out.append(pa.StructArray.from_arrays([pa.array(x) for x in (n, found, lo, hi, *places)], fields=list(_CUTS)))
        return _joined(out, _CUTS)

    return cut


def _summariser(auto: Automaton) -> Callable[..., Column]:
    """A chunk's transition function and its units for each state on entry."""

    @F.arrow_udf("state array<int>, units array<bigint>")
    def summary(chunk: pa.Array) -> pa.Array:
        out = []
        for data, off, _ in _pieces(chunk):
            start, length, sizes = blocks_of(off)
            state, units = prefixes(*scan(auto, auto.classes[data], start, length), sizes)
            last = np.cumsum(sizes) - 1
            ends = np.arange(len(last) + 1, dtype=np.int32) * state.shape[1]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[last].ravel(), t)) for x, t in ((state, pa.int32()), (units, pa.int64()))]
            out.append(pa.StructArray.from_arrays(lists, fields=list(_FUNCTION)))
        return _joined(out, _FUNCTION)

    return summary


def _composer(auto: Automaton) -> Callable[..., Column]:
    """From the functions of a text's chunks in order: units of the text, marker, and each chunk's state on entry and units before."""

    @F.arrow_udf("n bigint, found boolean, into array<int>, before array<bigint>")
    def compose(state: pa.Array, units: pa.Array) -> pa.Array:
        n_s, sizes = len(auto.step), state.value_lengths().to_numpy(zero_copy_only=False)
        f, g = (np.asarray(x.flatten().flatten()).reshape(-1, n_s) for x in (state, units))
        f, g = prefixes(f.astype(np.intp), g, sizes)
        last = np.cumsum(sizes) - 1
        into, before = entered(f, g, sizes, np.zeros(len(sizes), np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((into, pa.int32()), (before, pa.int64()))]
        return pa.StructArray.from_arrays([pa.array(g[last, 0]), pa.array(auto.found[f[last, 0]]), *lists], fields=list(_RESOLVED))

    return compose


def _seeker(auto: Automaton) -> Callable[..., Column]:
    """Byte at which a chunk's unit begins, from the state on entry."""

    @F.arrow_udf("bigint")
    def seek(chunk: pa.Array, entry: pa.Array, unit: pa.Array) -> pa.Array:
        out = []
        for data, off, (entry_, unit_) in _pieces(chunk, entry, unit):
            kinds = auto.classes[data]
            start, length, sizes = blocks_of(off)
            state, units = prefixes(*scan(auto, kinds, start, length), sizes)
            into, before = entered(state, units, sizes, entry_.astype(np.int64))
            inside = np.flatnonzero(unit_ >= 0)
            at = np.zeros(len(sizes), np.int64)
            at[inside] = find(auto, kinds, start, length, into, before, sizes, inside, unit_[inside]) - off[inside]
            out.append(pa.array(at))
        return _joined(out, pa.int64())

    return seek


def _up_to(limit: Column) -> Callable[[Column], Column]:
    return lambda x: x <= limit


def _giant_cuts(giants: DataFrame, auto: Automaton) -> DataFrame:
    """giants with __cut: chunks are scanned where Spark puts them, and their functions composed by text."""
    whole = materialise(giants.withColumn("__row", F.monotonically_increasing_id()))
    chunk = F.lit(CHUNK)
    raw = F.col("__text").cast("binary")
    split = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("__text") - 1) / chunk).cast("int")), lambda i: F.substring(raw, i * chunk + 1, chunk))
    chunks = whole.select("__row", F.posexplode(split).alias("__no", "__chunk")).repartition("__row", "__no")
    functions = chunks.select("__row", "__no", _summariser(auto)("__chunk").alias("f"))
    ordered = functions.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__no", "f"))).alias("f"))
    resolved = ordered.select(F.col("__row").alias("__of"), _composer(auto)(F.col("f.f.state"), F.col("f.f.units")).alias("r"))
    both = whole.join(resolved, F.col("__row") == F.col("__of"))
    cut = [F.pmod(h, F.col("r.n") + 1) for h in ("__h1", "__h2")]
    both = both.withColumns({"__lo": F.least(*cut), "__hi": F.greatest(*cut)})
    for end in ("lo", "hi"):
        unit = F.col(f"__{end}")
        no = F.size(F.filter("r.before", _up_to(unit))) - 1
        both = both.withColumn("__no", F.when(unit < F.col("r.n"), no))
        at = _seeker(auto)(
            F.coalesce(F.substring(raw, F.col("__no") * chunk + 1, chunk), F.lit(b"")), F.coalesce(F.get("r.into", F.col("__no")), F.lit(0)), F.coalesce(unit - F.get("r.before", F.col("__no")), F.lit(-1))
        )
        both = both.withColumn(f"__{end}_at", F.when(F.col("__no").isNull(), F.octet_length("__text").cast("long")).otherwise(F.col("__no") * chunk + at))
    made = F.struct(F.col("r.n").alias("n"), F.col("r.found").alias("found"), *[F.col(f"__{c}").alias(c) for c in ("lo", "hi", "lo_at", "hi_at")])
    return both.select(*giants.columns, made.alias("__cut"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Unit | None = None, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, n_units, form, prefix_units, middle_units, output), one row per input row; the units of plain texts' parts are null.

    unit: code_points() unless given, words() or lines(). A cut after k units is where the next unit begins, or the end.
    """
    ship_package(docs.sparkSession)
    auto = automaton(unit or code_points())
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = {f"__h{k + 1}": F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)}
    src = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumns(draws)
    giant = F.octet_length("__text") > CHUNK
    near = src.where(~giant).withColumn("__cut", _cutter(auto)("__text", "__h1", "__h2"))
    cut = near.unionByName(_giant_cuts(src.where(giant), auto))
    plain = (F.octet_length("__text") == 0) | F.col("__cut.found") | (F.col("__h3") % 100 >= transformed)
    form = F.when(plain, "plain").when(F.col("__h4") % 100 < suffix_first, "spm").otherwise("psm")
    raw, lo, hi = F.col("__text").cast("binary"), F.col("__cut.lo_at").cast("int"), F.col("__cut.hi_at").cast("int")
    parts = {"p": F.substring(raw, F.lit(1), lo), "m": F.substring(raw, lo + 1, hi - lo), "s": F.substring(raw, hi + 1, F.octet_length("__text") - hi)}
    mark = {"p": PREFIX, "m": MIDDLE, "s": SUFFIX}

    def shaped(order: str) -> Column:
        return F.concat(*[x for part in order for x in (F.lit(mark[part]).cast("binary"), parts[part])]).cast("string")

    output = F.when(F.col("form") == "plain", F.col("__text")).when(F.col("form") == "psm", shaped("psm")).otherwise(shaped("spm"))
    moved = F.col("form") != "plain"
    return cut.withColumn("form", form).select(
        F.col("__id").alias(id_col), F.col("__cut.n").alias("n_units"), "form",
        F.when(moved, F.col("__cut.lo")).alias("prefix_units"), F.when(moved, F.col("__cut.hi") - F.col("__cut.lo")).alias("middle_units"), output.alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text, from output and form alone: no part holds a marker, so each marker's first place is its own."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        a, b = F.instr(output, F.lit(second)), F.instr(output, F.lit(MIDDLE))
        n = len(first) + 1
        return F.substring(output, F.lit(n), a - n), F.substring(output, a + len(second), b - a - len(second)), F.substring(output, b + len(MIDDLE), F.length(output))

    p, s, m = between(PREFIX, SUFFIX)
    s2, p2, m2 = between(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(p, m, s)).otherwise(F.concat(p2, m2, s2))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", F.col("n_units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, lo) AS pre, substring(t, lo + 1, hi - lo) AS mid, substring(t, hi + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
