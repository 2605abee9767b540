"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams, with marks for its ends; a
passage of WINDOW words is the mean of its distinct words (so that a word said over and over counts once); a softmax over two
classes reads that mean. Vectors and softmax are trained jointly in numpy (Adam on minibatches). Misspelt or inflected words that
were never seen share n-grams with those that were. As all is linear, scoring needs one number
per n-gram bucket, so words are scored in vectorised sums over bytes. A text's score is that of its worst passage, by a logistic
curve, as a few toxic words vanish in the mean of a long text.

Training takes every passage of the sampled texts. A first stage gives a text's passages its label, those of a text with more than EVEN
passages weigh less, so that long texts don't outweigh others; a second stage takes the passages of clean texts and the worst ones of toxic texts.

Null and empty texts have no passage and get the score of one without known n-grams. Very long texts are scored in all their passages.
Repeated rows are scored one by one; ties don't matter, as each row is scored by itself; without usable labels all scores are 0.5; an
empty table gives an empty result. Only the named columns are read, so others cannot clash, unless they are kept (``keep``): then names
that begin with ``__`` as here are refused. Labels, language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from . import words as W
from .common import lean, remainder, ship_package

#: Bound on labelled documents that are fitted on, for each of the two labels; passages of a text from which on each weighs less in the first stage.
PER_CLASS, EVEN = 1800, 24
BUCKETS, DIMENSION, GRAMS, WINDOW = 1 << 17, 4, (3, 4, 5), 16
#: Only buckets met in so many of the training texts are learnt; others add nothing.
LEAST_TEXTS = 3
#: A passage of fewer distinct words is averaged as if filled up with neutral ones.
LEAST_WORDS = 10
#: Each update also shrinks all vectors and weights by this times the rate.
DECAY = 0.02
#: Texts are scored so many bytes at a time.
SLICE_BYTES = 3 << 19
EPOCHS, BATCH, RATE, LEAST_UPDATES, WORST = 3, 1000, 0.05, 240, 4
#: A mean is stretched by this, as few of its words bear on the label.
SCALE = np.float32(20.0)


def passages(per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage of each word, passages per text)."""
    count = -(-per // WINDOW)
    first = np.cumsum(count) - count
    place = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    return np.repeat(first, per) + place // WINDOW, count


def gram_buckets(vals: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram of each word, n-grams per word); the whole word is one more."""
    n = len(vals)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    off = np.frombuffer(vals.buffers()[1], np.int64)[vals.offset : vals.offset + n + 1]
    data = np.frombuffer(vals.buffers()[2], np.uint8)[off[0] : off[-1]]
    lens = np.diff(off) + 2
    ends = np.cumsum(lens)
    marked = np.empty(int(ends[-1]), np.uint64)
    body = np.ones(len(marked), bool)
    marked[ends - lens], marked[ends - 1] = 1, 2
    body[ends - lens] = body[ends - 1] = False
    marked[body] = data
    word_of = np.repeat(np.arange(n), lens)
    left = np.repeat(ends, lens) - np.arange(len(marked))
    found_word, found = [np.arange(n)], [W.hash_words(vals, 7) % np.uint64(buckets)]
    h = np.zeros(len(marked), np.uint64)
    prime = np.uint64(0x100000001B3)
    for k in range(min(max(GRAMS), len(marked))):
        h[: len(marked) - k] = h[: len(marked) - k] * prime + marked[k:] + np.uint64(1)
        if k + 1 in GRAMS:
            at = np.flatnonzero(left > k)
            found_word.append(word_of[at])
            found.append(W.mix64(h[at] + np.uint64(k)) % np.uint64(buckets))
    word, bucket = np.concatenate(found_word), np.concatenate(found).astype(np.int64)
    order = np.argsort(word, kind="stable")
    return bucket[order], np.bincount(word, minlength=n)


@dataclass
class SubwordModel:
    """Per bucket, what an n-gram adds to a passage's log odds of class 1; the bias; slope and offset of the scores' curve."""

    value: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def means(self, idx: np.ndarray, bucket: np.ndarray, grams: np.ndarray, window: np.ndarray, total: int) -> np.ndarray:
        """Log odds of each passage, less the bias."""
        word_of = np.repeat(np.arange(len(grams)), grams)
        word = np.bincount(word_of, weights=self.value[bucket], minlength=len(grams)) / np.maximum(grams, 1)
        v = len(grams)
        key = np.sort(window * v + idx)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        return np.bincount(key // v, weights=word[key % v], minlength=total) / np.maximum(np.bincount(key // v, minlength=total), LEAST_WORDS)

    def worst(self, col) -> np.ndarray:
        """Log odds of each text's worst passage."""
        idx, vals, per = W.batch_words(col)
        out = np.full(len(per), self.bias)
        if not len(idx):
            return out
        bucket, grams = gram_buckets(vals, len(self.value))
        window, count = passages(per)
        mean = self.means(idx, bucket, grams, window, int(count.sum()))
        some = count > 0
        out[some] += np.maximum.reduceat(mean, (np.cumsum(count) - count)[some])
        return out

    def logits(self, col) -> np.ndarray:
        return self.slope * self.worst(col) + self.offset

    def scores(self, col) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(col), -30, 30)))


@dataclass
class Passages:
    """All passages of the training texts as lists of words, words as lists of buckets; everything flat."""

    start: np.ndarray  # of each passage's words
    word: np.ndarray
    held: np.ndarray  # words that a passage is averaged over
    text: np.ndarray  # of each passage
    gram_start: np.ndarray  # of each word's learnt buckets
    gram: np.ndarray
    grams: np.ndarray  # all n-grams of each word, learnt or not
    met: np.ndarray  # mask of learnt buckets

    def word_values(self, value: np.ndarray) -> np.ndarray:
        of = np.repeat(np.arange(len(self.grams)), np.diff(self.gram_start))
        return np.bincount(of, value[self.gram], len(self.grams)) / np.maximum(self.grams, 1)

    def logits(self, value: np.ndarray) -> np.ndarray:
        of = np.repeat(np.arange(len(self.held)), np.diff(self.start))
        return np.bincount(of, self.word_values(value)[self.word], len(self.held)) / self.held


def collect(col) -> Passages:
    """The passages of all texts, a few texts at a time, for the task's memory; a word is listed once for each such part."""
    size, word, held, text, gram, learnable, grams = [], [], [], [], [], [], []
    count, words = np.zeros(BUCKETS, np.int64), 0
    for first in range(0, len(col), 128):
        part = col.slice(first, 128)
        idx, vals, per = W.batch_words(part)
        if not len(idx):
            continue
        bucket, n = gram_buckets(vals)
        v, begin = len(vals), np.concatenate(([0], np.cumsum(n)))
        window, many = passages(per)
        total = int(many.sum())
        key = np.unique(window * v + idx)
        size.append(np.bincount(key // v, minlength=total))
        held.append(np.maximum(size[-1], LEAST_WORDS))
        word.append((key % v + words).astype(np.int32))
        text.append(np.repeat(first + np.arange(len(per)), many))
        key = np.unique(np.repeat(np.arange(len(per)), per) * v + idx)  # words of each text, then buckets of each text
        of = np.repeat(key // v, n[key % v])
        pairs = np.unique(of * BUCKETS + W.ragged_take(bucket, begin, key % v))
        count += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        gram.append(bucket.astype(np.int32))
        grams.append(n)
        words += v
    met = count >= LEAST_TEXTS
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    gram, grams = cat(gram, np.int32), cat(grams, np.int64)
    learnable = met[gram]
    ends = np.concatenate(([0], np.cumsum(learnable)))[np.concatenate(([0], np.cumsum(grams)))]
    return Passages(np.concatenate(([0], np.cumsum(cat(size, np.int64)))), cat(word, np.int32), cat(held, np.int64).astype(np.float32), cat(text, np.int64), ends, gram[learnable], grams, met)


def _descend(net: list[np.ndarray], bags: Passages, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """Joint training of vectors and softmax on the passages ``rows``, both classes with equal weight."""
    vec, out, _ = net
    share = max(float(weight[y == 1].sum() / weight.sum()), 1e-9)
    cls = (np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-9)) * weight / weight.mean()).astype(np.float32)
    m1, m2, t = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
    batch = min(BATCH, max(64, len(rows) // 8))
    epochs = max(EPOCHS, -(-LEAST_UPDATES * batch // len(rows)))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            mine = rows[pick]
            row = np.repeat(np.arange(len(mine)), bags.start[mine + 1] - bags.start[mine])
            words, place = np.unique(W.ragged_take(bags.word, bags.start, mine), return_inverse=True)
            of = np.repeat(np.arange(len(words)), bags.gram_start[words + 1] - bags.gram_start[words])
            b = W.ragged_take(bags.gram, bags.gram_start, words)
            share_of = (1 / np.maximum(bags.grams[words], 1)).astype(np.float32)
            part, w = vec[b], 1 / bags.held[mine][row]
            mean = np.stack([np.bincount(of, part[:, k], len(words)) for k in range(DIMENSION)], 1) * share_of[:, None]
            hidden = np.stack([np.bincount(row, mean[place, k] * w, len(mine)) for k in range(DIMENSION)], 1).astype(np.float32) * SCALE
            z = hidden @ out + net[2]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(mine)), y[pick]] -= 1
            p *= cls[pick][:, None] / len(mine)
            dh = (p @ out.T) * SCALE
            back = np.stack([np.bincount(place, dh[row, k] * w, len(words)) for k in range(DIMENSION)], 1) * share_of[:, None]
            grads = [np.stack([np.bincount(b, back[of, k], len(vec)) for k in range(DIMENSION)], 1).astype(np.float32), hidden.T @ p, p.sum(0)]
            t += 1
            lr = RATE * (1 - epoch / epochs)
            for q, g, u, v in zip(net, grads, m1, m2, strict=True):
                u *= 0.9
                u += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q *= 1 - lr * DECAY
                q -= lr * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def fit(col, y: np.ndarray, seed: int = 1) -> SubwordModel:
    y = np.asarray(y).astype(np.int64)
    if not len(y) or y.min() == y.max():
        return SubwordModel(np.zeros(BUCKETS), 0.0)
    rng, bags = np.random.default_rng(seed), collect(col)
    text = bags.text
    if not len(text):
        return SubwordModel(np.zeros(BUCKETS), 0.0)
    net = [rng.normal(0, 0.01, (BUCKETS, DIMENSION)).astype(np.float32), rng.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32), np.zeros(2, np.float32)]
    even = 1 / np.maximum(np.bincount(text) / EVEN, 1)[text]
    _descend(net, bags, np.arange(len(text)), y[text], even, rng)

    def value() -> np.ndarray:
        return np.where(bags.met, net[0] @ (net[1][:, 1] - net[1][:, 0]), 0).astype(np.float64) * float(SCALE)

    logit = bags.logits(value())
    order = np.lexsort((-logit, text))
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text)) - np.searchsorted(text[order], text[order], side="left")
    bar = np.quantile(logit[y[text] == 0], 0.98) if (y[text] == 0).any() else 0.0
    rows = np.flatnonzero((y[text] == 0) | ((rank < WORST) & (logit > bar)) | (rank == 0))
    _descend(net, bags, rows, y[text[rows]], np.where(y[text] == 0, even, 1.0)[rows], rng)
    bias = float(net[2][1] - net[2][0])
    logit, some = bags.logits(value()), np.unique(text, return_index=True)
    worst = np.full(len(y), bias)
    worst[some[0]] += np.maximum.reduceat(logit, some[1])
    return SubwordModel(value(), bias, *curve(worst, y))


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve of y over x by Newton's method, slightly shrunk; a false alarm weighs as two misses."""
    w = np.where(y == 1, 0.5 / y.mean(), 1.0 / (1 - y.mean()))
    mid, size = x.mean(), x.std() + 1e-9
    m = np.stack(((x - mid) / size, np.ones(len(x))), 1)
    c = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(m @ c, -30, 30)))
        h = (m * (w * p * (1 - p))[:, None]).T @ m + np.diag([0.5, 1e-6])
        c = c + np.linalg.solve(h, m.T @ (w * (y - p)) - np.array([0.5, 1e-6]) * c)
    slope = max(float(c[0] / size), 0.0)
    return slope, float(c[1] - slope * mid)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> SubwordModel:
    """Fit on a sample of at most per_class documents of each label, in one task of an executor; the driver gets the finished model."""
    ship_package(docs.sparkSession)
    sample = labelled.sample(docs, labels, label, modulus, held_out, per_class, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), pa.schema([("text", pa.string()), ("y", pa.int32())]))
        got = got.sort_by([("text", "ascending"), ("y", "ascending")])  # rows arrive in any order
        m = fit(got.column("text").combine_chunks(), got.column("y").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([m.value.tobytes()], pa.binary()), *(pa.array([v]) for v in (m.bias, m.slope, m.offset))], ["value", "bias", "slope", "offset"])

    rows = sample.repartition(1).mapInArrow(lean(work), "value binary, bias double, slope double, offset double").collect()  # one row
    if not rows:
        return SubwordModel(np.zeros(BUCKETS), 0.0)
    return SubwordModel(np.frombuffer(rows[0]["value"], np.float64), rows[0]["bias"], rows[0]["slope"], rows[0]["offset"])


def score_documents(docs: DataFrame, model: SubwordModel, modulus: int = 3, held_out: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, held_out, score, predicted) for every row; with keep, all input columns besides (score, predicted)."""
    ship_package(docs.sparkSession)
    fields = docs.schema.fields if keep else [docs.schema[id_col]]
    names = [f.name for f in fields]
    if clash := {"__text", "__score", "__predicted"} & {n.lower() for n in names}:
        raise ValueError(f"reserved column names: {sorted(clash)}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, 0, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.scores(b.column(0)))], [*names, "__score"])

    src = docs.select(F.col(text_col).alias("__text"), *[F.col(f"`{n}`") for n in names])
    out = src.mapInArrow(lean(work), type(docs.schema)([*fields]).add("__score", "double"))
    predicted = (F.col("__score") >= threshold).cast("int")
    if keep:
        return out.withColumn("__predicted", predicted)
    return out.select(F.col(id_col), (remainder(F.col(id_col), modulus) == held_out).alias("held_out"), F.col("__score").alias("score"), predicted.alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, train(docs, labels))
