"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text's shape (letters, symbols, repetition, the worst of its windows) are
cut into bins. Boosting goes round the features in turn; each step fits a shallow tree
to one feature's bins and adds it to that feature's lookup table. Then the pairs of
features that explain most of what is left get two-dimensional tables the same way. A score
is a sum of table entries, one vectorised addition per feature or pair.

Texts that are null or empty have features of their own (all zero) and get a score like
others; very long ones are measured whole, in one pass. A score at the threshold counts as label 1. Repeated rows are scored one by one; without any usable label all scores are
0.5; an empty table gives an empty result. Only the named columns are read, so others
cannot clash; labels, language, source and id are never features.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from . import words as W
from .common import lean, remainder, ship_package

#: Bound on labelled documents that are fitted on, for each of the two labels.
PER_CLASS = 6000
WINDOW_WORDS = 24
#: Texts are measured so many bytes at a time.
SLICE_BYTES = 1 << 20

_LOW, _UP, _DIGIT, _BLANK, _LINE, _STOP, _MARK, _HIGH = range(8)
_KIND = np.full(256, _MARK, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = _LOW, _UP, _DIGIT, _HIGH
_KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[[44, 46]] = _BLANK, _LINE, _STOP

NAMES = [
    "log_chars", "log_words", "upper", "digit", "blank", "lines", "stops", "marks", "high", "word_length",
    "distinct", "repeats", "marked_words", "upper_words", "worst_marked", "worst_upper", "worst_repeats", "long_words",
]


def features(col) -> np.ndarray:
    """One row of len(NAMES) numbers for each text."""
    data, off = W.text_bytes(col)
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    if not n:
        return out
    size = np.diff(off)
    kind = _KIND[data]
    text_of = np.repeat(np.arange(n), size)
    count = np.bincount(text_of * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    share = count / np.maximum(size, 1)[:, None]
    s, e, per = W.word_spans(data, off)
    idx, vals = W.distinct(W.span_strings(W.lower_ascii(data), s, e))
    word_text = np.repeat(np.arange(n), per)
    words = np.maximum(per, 1)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(word_text, weights=x, minlength=n) / words

    def within(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return (c[e] - c[s]).astype(float)

    length = (e - s).astype(float)
    marked = within(kind == _MARK) > 0
    upper = within(kind == _UP) >= np.maximum(2, 0.6 * length)
    repeat = np.zeros(len(s), bool)
    repeat[1:] = (idx[1:] == idx[:-1]) & (word_text[1:] == word_text[:-1])
    order = np.sort(word_text * max(len(vals), 1) + idx) if len(idx) else np.zeros(0, np.int64)
    fresh = np.ones(len(order), bool)
    fresh[1:] = order[1:] != order[:-1]
    distinct = np.bincount(order[fresh] // max(len(vals), 1), minlength=n) / words if len(idx) else np.zeros(n)
    begins = np.cumsum(per) - per
    place = np.arange(len(s)) - np.repeat(begins, per)
    windows = -(-per // WINDOW_WORDS)
    first = np.cumsum(windows) - windows
    window = np.repeat(first, per) + place // WINDOW_WORDS
    total = int(windows.sum())
    held = np.maximum(np.bincount(window, minlength=total), WINDOW_WORDS / 2) if total else np.zeros(0)

    def worst(x: np.ndarray) -> np.ndarray:
        got = np.zeros(n)
        if total:
            some = windows > 0
            got[some] = np.maximum.reduceat(np.bincount(window, weights=x, minlength=total) / held, first[some])
        return got

    cols = [
        np.log1p(size), np.log1p(per), share[:, _UP], share[:, _DIGIT], share[:, _BLANK], count[:, _LINE] / words, share[:, _STOP], share[:, _MARK],
        share[:, _HIGH], mean(length), distinct, mean(repeat), mean(marked), mean(upper), worst(marked), worst(upper), worst(repeat), mean(length > 20),
    ]
    return np.stack(cols, axis=1)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """Value of each bin under a shallow regression tree over ordered bins (Newton leaves)."""
    parts = [(0, len(gradient))]
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        k = np.arange(a + 1, b)
        gl, hl, gt, ht = g[k] - g[a], h[k] - h[a], g[b] - g[a], h[b] - h[a]
        gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
        i = int(np.argmax(gain))
        return float(gain[i]), int(k[i])

    splits = [best(*parts[0])]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda j: splits[j][0])
        if splits[i][0] <= 1e-9:
            break
        (a, b), k = parts[i], splits[i][1]
        parts[i : i + 1], splits[i : i + 1] = [(a, k), (k, b)], [best(a, k), best(k, b)]
    value = np.zeros(len(gradient))
    for a, b in parts:
        value[a:b] = (g[b] - g[a]) / (h[b] - h[a] + penalty)
    return value


@dataclass
class AdditiveModel:
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            a, b = (np.searchsorted(self.pair_edges[k], x[:, k], side="right") for k in (i, j))
            out += table[a, b]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, rounds: int = 120, rate: float = 0.2, leaves: int = 4, pairs: int = 6, pair_rounds: int = 40, penalty: float = 2.0) -> AdditiveModel:
    """Cyclic boosting of shallow trees on the logistic loss; both labels weigh the same."""
    model = AdditiveModel()
    if not len(y) or y.min() == y.max():
        return model
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    cut = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    d = x.shape[1]
    model.edges = [cut(x[:, j], bins) for j in range(d)]
    where = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(d)]
    model.tables = [np.zeros(len(model.edges[j]) + 1) for j in range(d)]
    f = np.zeros(len(y))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return w * (y - p), w * p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            k = len(model.tables[j])
            step = rate * _tree(np.bincount(where[j], g, k), np.bincount(where[j], h, k), leaves, penalty)
            model.tables[j] += step
            f += step[where[j]]
    model.pair_edges = [cut(x[:, j], pair_bins) for j in range(d)]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], side="right") for j in range(d)]
    g, h = slopes()
    gain = []
    for i, j in itertools.combinations(range(d), 2):
        b = len(model.pair_edges[j]) + 1
        cell, k = coarse[i] * b + coarse[j], (len(model.pair_edges[i]) + 1) * b
        gain.append((float((np.bincount(cell, g, k) ** 2 / (np.bincount(cell, h, k) + penalty)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gain, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            b = table.shape[1]
            cell = coarse[i] * b + coarse[j]
            gt, ht = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h))
            rows = _tree(gt.sum(1), ht.sum(1), 2, penalty)  # split rows in two, then each half's columns
            step = np.zeros_like(table)
            for side in np.unique(rows):
                on = rows == side
                step[on] = rate * _tree(gt[on].sum(0), ht[on].sum(0), 2, penalty)
            table += step
            f += step[coarse[i], coarse[j]]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in W.slices(whole, 0):
            x = features(b.column(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), lists], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    ship_package(docs.sparkSession)
    got = labelled.sample(docs, labels, label, modulus, held_out, per_class, id_col, text_col).mapInArrow(lean(_feature_rows), "y int, x array<double>").toArrow()
    if not got.num_rows:
        return AdditiveModel()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # rows arrive in any order
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, model: AdditiveModel, modulus: int = 4, held_out: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, held_out, score, predicted) for every row; with keep, all input columns besides (score, predicted)."""
    ship_package(docs.sparkSession)
    fields = docs.schema.fields if keep else [docs.schema[id_col]]
    names = [f.name for f in fields]
    if clash := {"__text", "__score", "__predicted"} & {n.lower() for n in names}:
        raise ValueError(f"reserved column names: {sorted(clash)}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, 0, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.scores(features(b.column(0))))], [*names, "__score"])

    src = docs.select(F.col(text_col).alias("__text"), *[F.col(f"`{n}`") for n in names])
    schema = type(docs.schema)([*fields]).add("__score", "double")
    out = src.mapInArrow(lean(work), schema)
    score, predicted = F.col("__score"), (F.col("__score") >= threshold).cast("int")
    if keep:
        return out.withColumn("__predicted", predicted)
    return out.select(F.col(id_col), (remainder(F.col(id_col), modulus) == held_out).alias("held_out"), score.alias("score"), predicted.alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, train(docs, labels))
