"""LM scoring: a gated recurrent language model in numpy.

Counts of all training tokens come first (one grouped sum over the whole corpus). The
VOCABULARY commonest words are cut by frequency into classes; all other words fall into
rare classes by their last byte and whether they hold non-ASCII bytes. The output is
factored: P(class | state) by softmax, then P(word | class, state) by a softmax inside the class for the classes of the
SOFT commonest words, and by smoothed counts inside the others. Texts are coded once, two bytes a token;
training and scoring read the codes. Gated units (GRU) are trained by truncated
backpropagation on all windows of every training document, each in one round. Partitions
train copies of the model which are averaged block by block, in two levels, in ROUNDS rounds, each over
its own documents; so the weights depend on how rows lie in partitions. Scoring walks through whole documents window by window with the state carried.

Words are known by 64-bit hashes. Counts of the FREQUENT commonest words travel with the model
(a bounded table), the rest are joined.

A null text counts as empty: its end token alone. Repeated rows are scored one by one, ids may repeat or be null. Very long texts
are scored whole; a code row has two bytes for each of their words. Words of equal counts are ranked by their hash. If
nothing is in the training part, base scores are 0. An empty table gives an empty
result; only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import lean, materialise, remainder, ship_package

VOCABULARY, SOFT, FREQUENT, CLASSES, LAST = 16_000, 16_000, 200_000, 64, 12
EMBEDDING, HIDDEN, STEPS, RUN, ROUNDS, BLOCKS = 16, 24, 32, 16, 3, 16
#: Runs of windows in an update: so many that a slice gives about UPDATES groups, within bounds.
BATCH, UPDATES = (32, 256), 12
OUTPUT_ROWS, OUTPUT_CELLS, SCORE_ROWS, SETTLE, ROW_RATE = 2048, 1 << 17, 512, 1 << 15, 10.0
#: Bytes of text counted and coded, of codes learnt from and of codes scored at a time; the last are more, as each slice's longest texts are scored few at a time.
COUNT_BYTES, SLICE_BYTES, CODE_BYTES, SCORE_BYTES = 8 << 20, 6 << 20, 4 << 20, 8 << 20
#: Tokens that a copy of the model is worth: fewer, and partitions go together for training.
COPY_TOKENS = 1_000_000
RARE = 2 * LAST
#: A step's product has four parts: the state's part of the candidate, both gates, the symbol's part of the candidate. So the state goes into
#: the first three, the symbol into the last three. These are the columns of ``u`` in that order.
_UNITS = np.roll(np.arange(3 * HIDDEN), HIDDEN)
LOG10 = np.log(10.0)


def rare_class(vals: pa.Array) -> np.ndarray:
    """Class of each word by its last byte and by having bytes outside ASCII."""
    off = np.frombuffer(vals.buffers()[1], np.int64)[vals.offset : vals.offset + len(vals) + 1]
    data = np.frombuffer(vals.buffers()[2], np.uint8)
    high = np.concatenate(([0], np.cumsum(data[off[0] : off[-1]] >= 128))) if len(vals) else np.zeros(1, np.int64)
    wide = (high[off[1:] - off[0]] - high[off[:-1] - off[0]]) > 0
    last = data[off[1:] - 1].astype(np.int64) if len(vals) else np.zeros(0, np.int64)
    return (last * 7 % 31 % LAST) * 2 + wide


@dataclass
class Lexicon:
    """Frequent words' hashes (sorted) and counts, model words (sorted) and their ids, totals."""

    hashes: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    ids: np.ndarray
    word_class: np.ndarray  # of each model id; the end token is id 0, class 0
    class_start: np.ndarray  # model ids are grouped by class
    word_bias: np.ndarray
    class_bias: np.ndarray
    log_z: np.ndarray  # natural log of each rare class's mass
    in_class: np.ndarray  # natural log of each word's share of its class by counts; 0 where a softmax decides
    soft: int  # classes with a softmax inside
    ends: int
    total: int
    types: int


def make_lexicon(hashes: np.ndarray, counts: np.ndarray, rare_mass: np.ndarray, rare_types: np.ndarray, rare_of: np.ndarray, ends: int, total: int, types: int) -> Lexicon:
    """From the FREQUENT commonest words in falling order; masses of all words by rare class."""
    k = min(VOCABULARY, len(hashes))
    c = counts[:k].astype(float)
    share = np.cumsum(np.sqrt(c)) / max(np.sqrt(c).sum(), 1e-9)
    cls = 1 + np.minimum((share * CLASSES).astype(np.int64), CLASSES - 1)
    word_class = np.concatenate(([0], cls))
    class_start = np.searchsorted(word_class, np.arange(CLASSES + 2))
    all_c = np.concatenate(([ends], c)) + 0.5
    class_mass = np.bincount(word_class, all_c, CLASSES + 1)
    mass = rare_mass - np.bincount(rare_of[:k], c, RARE) + 0.5 * (rare_types - np.bincount(rare_of[:k], minlength=RARE)) + 0.5
    bias = np.log(np.concatenate((class_mass, mass)) + 0.5)
    bias[: CLASSES + 1][np.bincount(word_class, minlength=CLASSES + 1) == 0] = -40.0  # classes without words get no probability
    soft = int(np.searchsorted(class_start[1:], 1 + SOFT, side="right"))
    share = np.log(all_c / np.maximum(class_mass[word_class], 1e-9))
    order, by_word = np.argsort(hashes), np.argsort(hashes[:k])
    return Lexicon(
        hashes[order], counts[order], hashes[:k][by_word], 1 + by_word, word_class, class_start, share[: class_start[soft]].astype(np.float32), (bias - np.log(np.exp(bias).sum())).astype(np.float32),
        np.log(mass), np.where(word_class < soft, 0, share), soft, ends, total, types,
    )


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def start_params(lex: Lexicon, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    n, small = len(lex.word_class), lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    return {
        "emb": small(n + RARE + 1, EMBEDDING), "wx": small(EMBEDDING, 3 * HIDDEN) * 2, "bx": np.zeros(3 * HIDDEN, np.float32), "u": small(HIDDEN, 3 * HIDDEN) * 2,
        "wc": small(HIDDEN, 1 + CLASSES + RARE) * 0.1, "bc": lex.class_bias.copy(), "wo": small(len(lex.word_bias), HIDDEN) * 0.1, "bo": lex.word_bias.copy(),
    }


class Room(dict):
    """Arrays by name that are used again: fresh memory costs more than the arithmetic in it."""

    def of(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or len(self[name]) < size or self[name].dtype != kind:
            self[name] = np.empty(size, kind)
        return self[name][:size].reshape(shape)


def run_window(p: dict, x: np.ndarray, h: np.ndarray, keep: bool = True, room: Room | None = None) -> tuple[np.ndarray, tuple]:
    """States after each step (rows, steps, H) and, with keep, what backpropagation needs; else the room of a step is used again.

    Inside, all is laid out by step, unit, row, so that gates are whole blocks of memory. A step is one product: the state, the symbol
    and a one make the two gates (their sign turned: a logistic gate is 1 / (1 + exp(-x))), what the state and what the symbol give the candidate.
    Results lie in the room, up to its next window.
    """
    rows, steps = x.shape
    room = Room() if room is None else room
    kind, kept, g2, g3 = p["u"].dtype, steps if keep else 1, 2 * HIDDEN, 3 * HIDDEN
    w = np.zeros((4 * HIDDEN, HIDDEN + EMBEDDING + 1), kind)
    w[:g3, :HIDDEN] = p["u"].T[_UNITS]
    w[HIDDEN:, HIDDEN:-1], w[HIDDEN:, -1] = p["wx"].T, p["bx"]
    w[HIDDEN:g3] *= -1
    inputs, units, part = room.of("inputs", kind, steps + 1, HIDDEN + EMBEDDING + 1, rows), room.of("units", kind, kept, 4 * HIDDEN, rows), room.of("part", kind, HIDDEN, rows)
    inputs[0, :HIDDEN] = h.T
    symbols = p["emb"].take(x.T.ravel(), axis=0, out=room.of("symbols", kind, steps * rows, EMBEDDING), mode="clip")
    inputs[:steps, HIDDEN:-1] = symbols.reshape(steps, rows, -1).transpose(0, 2, 1)
    inputs[:, -1] = 1
    states = inputs[:, :HIDDEN]
    with np.errstate(over="ignore"):
        for t in range(steps):
            unit, before, after = units[t if keep else 0], states[t], states[t + 1]
            np.matmul(w, inputs[t], out=unit)
            g, n = unit[HIDDEN:g3], unit[g3:]
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[HIDDEN:], unit[:HIDDEN], out=part)
            n += part
            np.tanh(n, out=n)
            np.subtract(before, n, out=after)
            after *= g[:HIDDEN]
            after += n
    by_row = room.of("by row", kind, steps, rows, HIDDEN)
    by_row[:] = states[1:].transpose(0, 2, 1)
    return by_row.transpose(1, 0, 2), (inputs, units)


def _with_bias(p: dict) -> np.ndarray:
    """``wo`` with ``bo`` as its last column: what both are parts of, or a new table."""
    table = p["wo"].base
    return table if table is not None and table is p["bo"].base and table.shape == (len(p["wo"]), HIDDEN + 1) else np.column_stack((p["wo"], p["bo"]))


def _as_parts(p: dict) -> np.ndarray:
    """Makes ``wo`` and ``bo`` parts of one table, which is returned."""
    table = _with_bias(p)
    p["wo"], p["bo"] = table[:, :-1], table[:, -1]
    return table


def outputs(p: dict, lex: Lexicon, h: np.ndarray, cls: np.ndarray, word: np.ndarray, grads: dict | None = None, room: Room | None = None, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each token's class and word (word -1: rare); with grads, those of the states h.

    Token i stands on row at[i] of h, or on row i; rows without a token have gradient 0. Inside, tokens lie by class, so each class is a
    slice. Exponentials are left as they are: what is narrower is divided by their sums. Rows are shifted by their maximum only where it takes that.
    """
    room = Room() if room is None else room
    n, kind = len(cls), h.dtype
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    rows = order if at is None else at[order]
    of, own = cls[order], word[order]
    hs, scaled = room.of("hs", kind, n, HIDDEN + 1), room.of("scaled", kind, n, HIDDEN + 1)
    hs[:, :-1], hs[:, -1] = h.take(rows, axis=0, out=room.of("taken", kind, n, HIDDEN), mode="clip"), 1
    got, dh = np.empty(n), room.of("by class", kind, n, HIDDEN) if grads is not None else None
    start, cut = lex.class_start[: lex.soft + 1], np.searchsorted(of, np.arange(lex.soft + 1))
    inner, size, many = int(cut[-1]), np.diff(start), np.diff(cut)
    with np.errstate(over="ignore", invalid="ignore"):
        wide, out = np.concatenate((p["wc"], p["bc"][None])), len(p["bc"])
        ones = np.ones(max(out, int(size.max(initial=0))), kind)
        for a in range(0, n, OUTPUT_ROWS):  # pieces that stay in the processor's cache
            mine, some = hs[a : a + OUTPUT_ROWS], scaled[a : a + OUTPUT_ROWS]
            z = a + len(mine)
            e, place = room.of("classes", kind, z - a, out), np.arange(z - a) * out + of[a:z]
            for shift in (False, True):
                np.matmul(mine, wide, out=e)
                if shift:
                    e -= e.max(1, keepdims=True)
                logit = e.reshape(-1).take(place)
                np.exp(e, out=e)
                s = e @ ones[:out]
                if s.min() > 1e-25 and s.max() < 1e30:
                    break
            got[a:z] = logit - np.log(s)
            if grads is not None:
                e.reshape(-1)[place] -= s
                np.reciprocal(s, out=s)
                np.multiply(mine, s[:, None], out=some)
                np.matmul(e, p["wc"].T, out=dh[a:z])
                dh[a:z] *= s[:, None]
                more = e.T @ some
                grads["wc"] += more[:, :-1].T
                grads["bc"] += more[:, -1]
        if lex.soft <= CLASSES:
            got += np.where(own >= 0, lex.in_class[own], 0)
        begin = np.cumsum(many * size) - many * size
        k = of[:inner]
        place = begin[k] + (np.arange(inner) - cut[k]) * size[k] + own[:inner] - start[k]  # each token's word among the outputs of all classes, one after the other
        table = _with_bias(p)
        inside, sums = np.empty(inner, kind), np.empty(inner, kind)
        if grads is not None:
            back, total = room.of("word back", kind, inner, HIDDEN), _as_parts(grads)
        some = np.flatnonzero(many)
        for group in np.split(some, np.flatnonzero(np.diff(begin[some] // OUTPUT_CELLS)) + 1):  # again, pieces that stay in the cache
            if not len(group):
                continue
            i, j, low = cut[group[0]], cut[group[-1] + 1], begin[group[0]]
            flat, place[i:j] = room.of("words", kind, int((many * size)[group].sum())), place[i:j] - low
            parts = [(slice(start[k], start[k + 1]), slice(cut[k], cut[k + 1]), flat[begin[k] - low :][: many[k] * size[k]].reshape(many[k], size[k])) for k in group.tolist()]
            for shift in (False, True):
                for words, tokens, e in parts:
                    np.matmul(hs[tokens], table[words].T, out=e)
                    if shift:
                        e -= e.max(1, keepdims=True)
                inside[i:j] = flat.take(place[i:j])
                np.exp(flat, out=flat)
                for _, tokens, e in parts:
                    np.matmul(e, ones[: e.shape[1]], out=sums[tokens])
                if sums[i:j].min() > 1e-25 and sums[i:j].max() < 1e30:
                    break
            if grads is not None:
                flat[place[i:j]] -= sums[i:j]
                np.divide(hs[i:j], sums[i:j, None], out=scaled[i:j])
                for words, tokens, e in parts:
                    np.matmul(e, p["wo"][words], out=back[tokens])
                    total[words] += e.T @ scaled[tokens]
    got[:inner] += np.where(size[of[:inner]] > 1, inside - np.log(sums), 0)  # a word alone in its class is sure
    logp = np.empty(n)
    logp[order] = got
    if grads is None:
        return logp, None
    back /= sums[:, None]
    dh[:inner] += back
    by_row = room.of("by token", kind, *h.shape)
    if n < len(h):
        by_row[:] = 0
    by_row[rows] = dh
    return logp, by_row


def back_window(p: dict, x: np.ndarray, kept: tuple, dstates: np.ndarray, grads: dict, room: Room | None = None) -> np.ndarray:
    """Truncated backpropagation: gradients stop at the window's first state. Returns the symbols met; what was kept is used up."""
    inputs, units = kept
    room = Room() if room is None else room
    (steps, _, rows), kind, g2, g3 = units.shape, units.dtype, 2 * HIDDEN, 3 * HIDDEN
    wanted = room.of("wanted", kind, steps, HIDDEN, rows)
    wanted[:] = dstates.transpose(1, 2, 0)
    un, z, r, cand = units[:, :HIDDEN], units[:, HIDDEN:g2], units[:, g2:g3], units[:, g3:]
    rest, dz_of = room.of("rest", kind, steps, HIDDEN, rows), room.of("dz", kind, steps, HIDDEN, rows)
    np.subtract(1, z, out=rest)
    np.subtract(inputs[:-1, :HIDDEN], cand, out=dz_of)  # what a step's gradient is multiplied by
    dz_of *= z
    dz_of *= rest
    dn_of, dr_of = cand, un
    dn_of *= cand
    np.subtract(1, dn_of, out=dn_of)
    dn_of *= rest
    np.subtract(1, r, out=rest)
    dr_of *= r
    dr_of *= rest
    back = room.of("back", kind, steps, 4 * HIDDEN, rows)
    dh, more, u = np.zeros((HIDDEN, rows), kind), np.empty((HIDDEN, rows), kind), p["u"][:, _UNITS]
    for t in range(steps - 1, -1, -1):
        dh += wanted[t]
        d = back[t]
        dn = d[g3:]
        np.multiply(dh, dn_of[t], out=dn)
        np.multiply(dh, dz_of[t], out=d[HIDDEN:g2])
        np.multiply(dn, dr_of[t], out=d[g2:g3])
        np.multiply(dn, r[t], out=d[:HIDDEN])
        dh *= z[t]
        dh += np.matmul(u, d[:g3], out=more)
    gu, gx = np.matmul(back[:, :g3], inputs[:-1, :HIDDEN].transpose(0, 2, 1)).sum(0), np.matmul(back[:, HIDDEN:], inputs[:-1, HIDDEN:].transpose(0, 2, 1)).sum(0)
    grads["u"][:, _UNITS] += gu.T
    grads["wx"] += gx[:, :-1].T
    grads["bx"] += gx[:, -1]
    by_symbol = np.matmul(back[:, HIDDEN:].transpose(0, 2, 1), p["wx"].T, out=room.of("by symbol", kind, steps, rows, EMBEDDING)).reshape(-1, EMBEDDING)
    sym = x.T.ravel()
    order = np.argsort(sym.astype(np.uint16), kind="stable")
    sym = sym[order]
    first = np.flatnonzero(np.concatenate(([True], sym[1:] != sym[:-1])))
    grads["emb"][sym[first]] += np.add.reduceat(by_symbol.take(order, axis=0), first, axis=0)
    return sym[first]


class Adam:
    """Adam for the small matrices. The two tables with a row per word take steps scaled by each row's mean squared
    gradient, which touch only the rows met.
    """

    def __init__(self, p: dict, rate: float):
        small = [k for k in p if k not in ("emb", "wo")]
        self.m, self.v, self.t, self.rate = {k: np.zeros_like(p[k]) for k in small}, {k: np.zeros_like(p[k]) for k in small}, 0, rate
        self.rows = {k: np.zeros(len(p[k]), np.float32) for k in ("emb", "wo")}

    def step(self, p: dict, g: dict, symbols: np.ndarray, tokens: int) -> None:
        """One update from the summed gradients of so many tokens; the gradients are set to zero."""
        self.t += 1
        lr = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k in self.m:
            mean = g[k] / tokens
            self.m[k] += 0.1 * (mean - self.m[k])
            self.v[k] += 0.01 * (mean * mean - self.v[k])
            p[k] -= lr * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)
            g[k].fill(0)
        table, more = _as_parts(p), _as_parts(g)  # whole rows are faster than parts of them; the biases, which are done, are 0 there
        for k, on, to, of in (("emb", symbols, p["emb"], g["emb"]), ("wo", slice(None), table, more)):
            mine, seen = of[on], self.rows[k]
            seen[on] += np.einsum("ij,ij->i", mine, mine) / p[k].shape[1]
            mine *= (ROW_RATE * self.rate / (np.sqrt(seen[on]) + 1e-6))[:, None]
            to[on] -= mine
            of[on] = 0


def symbols(lex: Lexicon, at: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Code of each distinct word, given its place among the frequent words (or -1): its model id, or one of the RARE codes after those."""
    ids = np.full(len(lex.hashes) + 1, -1)
    ids[np.searchsorted(lex.hashes, lex.words)] = lex.ids
    code = ids[at]
    return np.where(code >= 0, code, len(lex.word_class) + rare).astype(np.uint16)


def code_tables(lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, model word or -1, input symbol) of each code."""
    n = len(lex.word_class)
    return np.concatenate((lex.word_class, 1 + CLASSES + np.arange(RARE))), np.concatenate((np.arange(n), np.full(RARE, -1))), np.arange(n + RARE)


def _layout(per: np.ndarray, idx: np.ndarray, cls: np.ndarray, word: np.ndarray, sym: np.ndarray, n_model: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, class, word, input) of the token stream, each text with its end token (class 0, word 0)."""
    length = per + 1
    start = np.cumsum(length) - length
    total = int(length.sum())
    c, w, x = np.zeros(total, np.int32), np.zeros(total, np.int32), np.empty(total + 1, np.int32)
    body = np.arange(len(idx)) + np.repeat(np.arange(len(per)), per)
    idx = idx.astype(np.intp)
    c[body], w[body] = cls.astype(np.int32).take(idx), word.astype(np.int32).take(idx)
    x[body + 1] = sym.astype(np.int32).take(idx)
    x = x[:-1]
    x[start] = n_model + RARE
    return start, length, c, w, x


def text_logs(p: dict, lex: Lexicon, per: np.ndarray, idx: np.ndarray, cls: np.ndarray, word: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """Natural log probability of each text's classes and model words, the state carried across windows."""
    start, length, c, w, x = _layout(per, idx, cls, word, sym, len(lex.word_class))
    order, out, room = np.argsort(-length, kind="stable"), np.zeros(len(per)), Room()
    waiting, held = room.of("waiting", np.float32, SETTLE + SCORE_ROWS * STEPS, HIDDEN), 0
    tokens: list[tuple[np.ndarray, np.ndarray]] = []
    _as_parts(p)

    def settle() -> None:
        """Outputs of the states that wait, once they are many: they don't bear on later states."""
        tok, text = (np.concatenate([v[k] for v in tokens]) for k in range(2))
        out[:] += np.bincount(text, outputs(p, lex, waiting[:held], c[tok], w[tok], room=room)[0], len(out))
        tokens.clear()

    for first in range(0, len(order), SCORE_ROWS):
        group = order[first : first + SCORE_ROWS]
        h = np.zeros((len(group), HIDDEN), np.float32)
        for begin in range(0, int(length[group[0]]), STEPS):
            rows = group[: int((length[group] > begin).sum())]
            place, live = _window(start[rows], length[rows], begin)
            states, _ = run_window(p, x[place].T, h[: len(rows)], False, room)
            h = states[:, -1]
            at = np.flatnonzero(live)
            _rows(states).take(at, axis=0, out=waiting[held : held + len(at)], mode="clip")
            tokens.append((place.ravel()[at], rows[at % len(rows)]))
            held += len(at)
            if held >= SETTLE:
                settle()
                held = 0
    if held:
        settle()
    return out


def _rows(states: np.ndarray) -> np.ndarray:
    """The states of run_window as they lie: one row for each step and text."""
    return states.transpose(1, 0, 2).reshape(-1, HIDDEN)


def _window(start: np.ndarray, length: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """By step, (places, mask of those that count) of each text's window; past its end a text stays at its last token."""
    left = np.minimum(length - begin, STEPS)
    step = np.arange(int(left.max()))[:, None]
    return start + begin + np.minimum(step, left - 1), step < left


def train_texts(p: dict, lex: Lexicon, opt: Adam, per: np.ndarray, idx: np.ndarray, cls: np.ndarray, word: np.ndarray, sym: np.ndarray) -> int:
    """Updates over all windows of each text; returns the tokens learnt from.

    Texts are cut into runs of RUN windows, over which the state is carried, so that updates are over many tokens.
    """
    start, length, c, w, x = _layout(per, idx, cls, word, sym, len(lex.word_class))
    size = RUN * STEPS
    runs = -(-length // size)
    text = np.repeat(np.arange(len(length)), runs)
    skip = (np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)) * size
    start, length = start[text] + skip, np.minimum(length[text] - skip, size)
    order, seen = np.lexsort((W.mix64(np.arange(len(length))), -(-length // STEPS))), 0
    batch = int(np.clip(len(order) // UPDATES, *BATCH))
    grads, room = {n: np.zeros(v.shape, v.dtype) for n, v in p.items()}, Room()
    groups = [order[a : a + batch] for a in range(0, len(order), batch)]
    for k in np.random.default_rng(len(order)).permutation(len(groups)):  # short and long ones in turn
        group = groups[k][np.argsort(-length[groups[k]], kind="stable")]
        h = np.zeros((len(group), HIDDEN), np.float32)
        for begin in range(0, int(length[group[0]]), STEPS):
            rows = group[: int((length[group] > begin).sum())]
            place, live = _window(start[rows], length[rows], begin)
            states, kept = run_window(p, x[place].T, h[: len(rows)], room=room)
            at = np.flatnonzero(live)
            tok = place.ravel()[at]
            _, d = outputs(p, lex, _rows(states), c[tok], w[tok], grads, room, at)
            met = back_window(p, x[place].T, kept, d.reshape(*place.shape, HIDDEN).transpose(1, 0, 2), grads, room)
            opt.step(p, grads, met, len(tok))
            h = states[:, -1]
            seen += len(tok)
    return seen


def _flatten(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unflatten(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32).copy()
        at += like[k].size
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, rare, c) of each slice's training words; the end token has a null h."""
    for whole in batches:
        for b in W.slices(whole, 0, COUNT_BYTES, 1 << 14):
            idx, vals, per = W.batch_words(b.column(0))
            c = np.bincount(idx, minlength=len(vals)).astype(np.int64)
            h = pa.concat_arrays([pa.array(W.hash_words(vals).view(np.int64)), pa.nulls(1, pa.int64())])
            yield pa.RecordBatch.from_arrays([h, pa.array(np.append(rare_class(vals), 0).astype(np.int32)), pa.array(np.append(c, b.num_rows))], ["h", "rare", "c"])


_CODED = ["kind", "rid", "id", "held", "n", "known", "base", "score", "h", "codes"]


def _coder(lex: Lexicon):
    """Kind 0: a document's sums over words by counts, and its codes. Kind 1: (rid, h, n) of words whose counts are to be joined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.slices(whole, 3, SLICE_BYTES, 8192):
                m = b.num_rows
                idx, vals, per = W.batch_words(b.column(3))
                hashes, rare = W.hash_words(vals).view(np.int64), rare_class(vals)
                at = find(lex.hashes, hashes)
                here, code = at >= 0, symbols(lex, at, rare)
                count = np.where(here, lex.counts[np.maximum(at, 0)] if len(lex.counts) else 0, 0)
                log_c = np.where(here, np.log10(count + 0.5), 0.0)
                text_of = np.repeat(np.arange(m), per)
                add = lambda v: np.bincount(text_of, v[idx], m).astype(float)  # noqa: E731, B023
                base = add(log_c) + np.log10(lex.ends + 0.5)
                score = add(np.where(code >= len(lex.word_class), log_c - lex.log_z[rare] / LOG10, 0.0))
                known = add((here & (count > 0)).astype(float)) + (lex.ends > 0)
                cut = pa.array(np.concatenate(([0], 2 * np.cumsum(per))), pa.int32())
                codes = pa.Array.from_buffers(pa.binary(), m, [None, cut.buffers()[1], pa.py_buffer(code[idx])])
                zeros = pa.array(np.zeros(m, np.int32))
                yield pa.RecordBatch.from_arrays([zeros, *b.columns[:3], pa.array(per + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.nulls(m, pa.int64()), codes], _CODED)
                far = ~here[idx]
                if far.any():
                    key = text_of[far] * max(len(vals), 1) + idx[far]
                    key, tf = np.unique(key, return_counts=True)
                    k = len(key)
                    rid = b.column(0).take(pa.array(key // len(vals)))
                    none = [pa.nulls(k, t) for t in (b.column(1).type, pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), rid, *none[:2], pa.array(tf.astype(np.int64)), *none[2:5], pa.array(hashes[key % len(vals)]), none[5]], _CODED)

    return work


def _decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words per text, all codes) of a column of codes."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.diff(off) // 2, np.frombuffer(data, np.uint16)[off[0] // 2 : off[-1] // 2] if data is not None else np.zeros(0, np.uint16)


def _trainer(lex: Lexicon, flat: np.ndarray, rate: float, fan: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _unflatten(flat, start_params(lex))
        opt, seen, tables = Adam(p, rate), 0, code_tables(lex)
        for whole in W.regrouped(batches, 0, CODE_BYTES):
            for b in W.slices(whole, 0, CODE_BYTES, 1 << 14):
                per, codes = _decoded(b.column(0))
                seen += train_texts(p, lex, opt, per, codes, *tables)
        if seen:
            parts = np.array_split(_flatten(p).astype(np.float32) * np.float32(seen), BLOCKS)
            slot = TaskContext.get().partitionId() % fan
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([slot] * BLOCKS, pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "slot", "seen", "blob"])

    return work


_SUMS = "block int, slot int, seen bigint, blob binary"


def _sum_up(t: pa.Table) -> pa.Table:
    """One row of sums of the group's rows."""
    total = 0
    for x in t.column("blob"):
        total = total + np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
    first = [t.column(c)[0].as_py() for c in ("block", "slot")]
    return pa.table([pa.array(first[:1], pa.int32()), pa.array(first[1:], pa.int32()), pa.array([sum(t.column("seen").to_pylist())], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["block", "slot", "seen", "blob"])


def _scorer(lex: Lexicon, flat: np.ndarray):
    """Adds what the model makes of a document's codes to its score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, tables = _unflatten(flat, start_params(lex)), code_tables(lex)
        for whole in W.regrouped(batches, 7, SCORE_BYTES):
            for b in W.slices(whole, 7, SCORE_BYTES, 1 << 15):
                per, codes = _decoded(b.column(7))
                score = b.column(6).to_numpy() + text_logs(p, lex, per, codes, *tables) / LOG10
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(score)], ["rid", "id", "held", "n", "known", "base", "score"])

    return work


def score_documents(docs: DataFrame, modulus: int = 5, held_out: int = 1, rate: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row."""
    spark = docs.sparkSession
    ship_package(spark)
    id_type = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("held", remainder(F.col("id"), modulus) == held_out)
    training = src.where(~F.col("held"))
    counts = materialise(training.select("text").mapInArrow(lean(_count), "h bigint, rare int, c bigint").groupBy("h").agg(F.first("rare").alias("rare"), F.sum("c").alias("c")))
    ends = counts.where("h is null").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    by_class = counts.where("h is not null").groupBy("rare").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()  # one row per rare class
    mass, types = np.zeros(RARE), np.zeros(RARE)
    for r in by_class:
        mass[r["rare"]], types[r["rare"]] = r["c"], r["n"]
    top = counts.where("h is not null").orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    lex = make_lexicon(*(top.column(c).to_numpy() for c in ("h", "c")), mass, types, top.column("rare").to_numpy(), ends, int(mass.sum()) + ends, int(types.sum()) + (ends > 0))
    coded = src.select(F.monotonically_increasing_id().alias("rid"), "id", "held", "text").mapInArrow(lean(_coder(lex)), f"kind int, rid bigint, id {id_type}, held boolean, n bigint, known bigint, base double, score double, h bigint, codes binary")
    coded = materialise(coded)
    rows, flat = coded.where("kind = 0").drop("kind", "h"), _flatten(start_params(lex))
    copies = min(rows.rdd.getNumPartitions(), max(1, -(-lex.total // COPY_TOKENS)))
    fan = max(1, int(np.ceil(np.sqrt(copies))))  # both levels of sums have about as many terms
    for r in range(ROUNDS):
        mine = rows.where(~F.col("held") & (F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == r)).select("codes").coalesce(copies)
        sums = mine.mapInArrow(lean(_trainer(lex, flat, rate / (1 + r), fan)), _SUMS).groupBy("block", "slot").applyInArrow(_sum_up, _SUMS).groupBy("block").applyInArrow(_sum_up, _SUMS)
        got = sorted((r["block"], r["seen"], r["blob"]) for r in sums.collect())  # BLOCKS rows
        if got:
            flat = np.concatenate([np.frombuffer(x, np.float32) / n for _, n, x in got]).astype(np.float32)
    scored = rows.select("rid", "id", "held", "n", "known", "base", "score", "codes").mapInArrow(lean(_scorer(lex, flat)), f"rid bigint, id {id_type}, held boolean, n bigint, known bigint, base double, score double")
    rest = counts.where("h is not null").select(F.col("h").alias("w"), "c")
    far = coded.where("kind = 1").select("rid", F.col("n").alias("tf"), F.col("h").alias("w")).join(rest, "w", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    far = far.groupBy("rid").agg(F.sum(F.col("tf") * F.log10(c + 0.5)).alias("far"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("far_known"))
    out = scored.join(far, "rid", "left")
    more = F.coalesce("far", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n") * F.lit(float(np.log10(lex.total + 0.5 * (lex.types + 1))))).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
