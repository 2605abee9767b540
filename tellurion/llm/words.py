"""Vectorised word handling over Arrow string columns.

A *word* is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  All of the functions
work on a whole Arrow batch at once with numpy; there is no per-word Python code.
Because ASCII white space never occurs inside a UTF-8 multi-byte sequence, byte
positions of words are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that scatters 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte positions of all words and their counts per text; gaps: which of the 256 bytes part words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off) - 1, np.int64)
    solid = ~gaps[data]
    edge = np.zeros(n + 1, dtype=bool)  # a text's first byte always opens a word
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    cuts = np.searchsorted(starts, off)
    return starts, ends, np.diff(cuts)


def span_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow binary array (gaps between spans are squeezed out)."""
    lens = ends - starts
    off = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    if len(lens) and (off[-1] != ends[-1] - starts[0]):
        mask = np.zeros(len(data) + 1, np.int8)
        mask[starts] = 1
        mask[ends] -= 1  # two texts may touch: an end may also be a start
        data = data[np.cumsum(mask[:-1], dtype=np.int8).astype(bool)]
    elif len(lens):
        data = data[starts[0] : ends[-1]]
    else:
        data = data[:0]
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def distinct(spans: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(index of each span in the distinct values, distinct values)."""
    d = spans.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def batch_words(col, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word index per token, distinct words as binary, words per text)."""
    data, off = text_bytes(col)
    if lower:
        data = lower_ascii(data)
    s, e, per = word_spans(data, off)
    idx, vals = distinct(span_strings(data, s, e))
    return idx, vals, per


def hash_words(vals: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the distinct words, by bytes, eight at a time."""
    n = len(vals)
    if not n:
        return np.zeros(0, np.uint64)
    off = np.frombuffer(vals.buffers()[1], np.int64)[vals.offset : vals.offset + n + 1]
    data = np.frombuffer(vals.buffers()[2], np.uint8)
    lens = np.diff(off)
    h = mix64(lens.astype(np.uint64) + np.uint64((seed * int(_M1) + int(_M3)) & (2**64 - 1)))
    padded = np.concatenate([data[: off[-1]], np.zeros(8, np.uint8)])
    live = np.arange(n)
    at = off[:-1].astype(np.int64)
    left = lens.astype(np.int64)
    while len(live):
        live, at, left = (a[left > 0] for a in (live, at, left))
        if not len(live):
            break
        w = np.zeros(len(live), np.uint64)
        for k in range(8):
            b = padded[np.minimum(at + k, len(padded) - 1)].astype(np.uint64)
            w |= np.where(left > k, b, np.uint64(0)) << np.uint64(8 * k)
        h[live] = mix64(h[live] * _M1 + w)
        at, left = at + 8, left - 8
    return h


def shingle_sets(col, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct k-word shingles of each text in rising order, counts per text).

    A text of fewer than k words, but at least one, has its whole sequence as one shingle.
    """
    idx, vals, per = batch_words(col)
    h = hash_words(vals)[idx] if len(idx) else np.zeros(0, np.uint64)
    n, docs = len(h), len(per)
    ends = np.cumsum(per)
    doc_of = np.repeat(np.arange(docs), per)
    acc = np.zeros(n, np.uint64)
    width = np.minimum(per, k)[doc_of] if n else np.zeros(0, np.int64)
    full = np.arange(n) + width <= ends[doc_of] if n else np.zeros(0, bool)
    at = np.flatnonzero(full)
    w = width[at]
    acc = mix64(w.astype(np.uint64) * _M1 + _M2)
    for j in range(k):
        on = w > j
        if on.all():
            acc = mix64(acc * _M1 + h[at + j])
        else:
            acc[on] = mix64(acc[on] * _M1 + h[at[on] + j])
    d = doc_of[at]
    counts = np.bincount(d, minlength=docs) if docs else np.zeros(0, np.int64)
    out, sizes, p = [], np.zeros(docs, np.int64), 0
    for i, c in enumerate(counts):
        if c:
            u = np.sort(acc[p : p + c])
            u = u[np.concatenate(([True], u[1:] != u[:-1]))]
            out.append(u)
            sizes[i] = len(u)
            p += c
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def unit_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of units, each a run of ASCII white space and the run of other bytes after it.

    Units cover every byte. Byte-level tokenizers never join bytes of two units.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off) - 1, np.int64)
    space = _SPACE[data]
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = space[1:] & ~space[:-1]
    head = off[:-1][np.diff(off) > 0]
    first[head] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    return starts, ends, np.diff(np.searchsorted(starts, off))


def slices(batch: pa.RecordBatch, col: int, max_bytes: int = 3 << 20, max_rows: int = 4096):
    """Pieces of a batch with about max_bytes of text each, to bound a worker's memory."""
    n = batch.num_rows
    if not n:
        return
    data = pa.compute.binary_length(batch.column(col)).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(data, dtype=np.int64)
    begin = 0
    while begin < n:
        base = total[begin - 1] if begin else 0
        end = int(np.searchsorted(total, base + max_bytes, side="right"))
        end = min(max(end, begin + 1), begin + max_rows, n)
        yield batch.slice(begin, end - begin)
        begin = end


def regrouped(batches: Iterator[pa.RecordBatch], col: int, min_bytes: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches put together until their column holds min_bytes."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        waiting.append(b)
        held += pa.compute.sum(pa.compute.binary_length(b.column(col))).as_py() or 0
        if held >= min_bytes:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, held = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def ragged_take(values: np.ndarray, off: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Concatenation of values[off[i]:off[i+1]] for i in idx."""
    lens = (off[1:] - off[:-1])[idx]
    total = int(lens.sum())
    if not total:
        return values[:0]
    shift = np.repeat(off[idx] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
    return values[np.arange(total) + shift]
