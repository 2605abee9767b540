"""BPE encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds (merge rank, place) of
all adjacent pairs. The lowest rank is merged first, entries whose symbols have changed
since are skipped as stale. Decoding concatenates the vocabulary strings, with the blank
that the vocabulary's missing decoder puts between tokens. Normalising and splitting a word into
pre-tokens follow the vocabulary file; each distinct word is encoded once per worker.

A null text counts as empty: no tokens, hashes of the empty string. Very long texts and words are encoded whole; equal
ranks merge from the left. Strings of special
tokens in a text become those tokens, as in the library. Repeated rows stay; an empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import lean, ship_package
from .op7_packing import byte_alphabet, tokenizer_file

CACHE_WORDS, CACHE_PIECES = 1_200_000, 700_000
_PUNCTUATION = "!\"#$%&()*+,-./:;=?@[]^_`{|}~"  # apostrophes begin contractions, "<" special tokens
_CACHE: dict = {}


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (*self.vocab.items(), *self.special.items())}
        self.base = max(self.strings) + 1
        self.ranks: dict[int, int] = {}  # left * base + right: merge rank
        self.made: list[int] = []  # by rank
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[self.vocab[a] * self.base + self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.alphabet = byte_alphabet()
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.find_special = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")")
        self.pieces: dict[str, tuple[str, str, int]] = {}
        self.clear()

    @classmethod
    def of(cls, path: str) -> Bpe:
        if path not in _CACHE:
            _CACHE[path] = cls(path)
        return _CACHE[path]

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge by rank, then place, over a doubly linked list.

        A queue entry is rank * n + place; it is stale unless the pair there still has that rank.
        """
        n, rank_of, base, made = len(symbols), self.ranks.get, self.base, self.made
        if n < 2:
            return symbols
        sym = list(symbols)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            r = rank_of(sym[i] * base + sym[i + 1])
            if r is not None:
                queue.append(r * n + i)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            r, i = divmod(pop(queue), n)
            j = nxt[i]
            if j >= n or sym[i] < 0 or rank_of(sym[i] * base + sym[j]) != r:
                continue
            k = nxt[j]
            new = sym[i] = made[r]
            sym[j], nxt[i] = -1, k
            if k < n:
                prv[k] = i
                r = rank_of(new * base + sym[k])
                if r is not None:
                    push(queue, r * n + i)
            h = prv[i]
            if h >= 0:
                r = rank_of(sym[h] * base + new)
                if r is not None:
                    push(queue, r * n + h)
        return [s for s in sym if s >= 0]

    def _piece(self, piece: str) -> tuple[str, str, int]:
        """(ids, vocabulary strings, number of ids) of a pre-token, which is in the byte alphabet."""
        got = self.pieces.get(piece)
        if got is None:
            chars = list(piece)
            if self.suffix:
                chars[-1] += self.suffix
            ids = self.merge([self.vocab[c] for c in chars if c in self.vocab])
            got = self.pieces[piece] = (" ".join(map(str, ids)), self.decode(ids), len(ids))
        return got

    def _letters(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word) and "İ" not in word and "Σ" not in word)

    def parts(self, word: str) -> list[tuple[str, str, int]]:
        """Encoded pre-tokens of a text without ASCII white space."""
        body = word.rstrip(_PUNCTUATION)
        if self._letters(body):
            low = body.lower()
            out = [self._piece(low if low.isascii() else "".join([self.alphabet[b] for b in low.encode()]))]
            if len(body) < len(word):
                out.append(self._piece(word[len(body) :]))
            return out
        out = []
        for part in self.find_special.split(word):
            if part in self.special:
                i = self.special[part]
                out.append((str(i), part, 1))
            elif part:
                out += [self._piece(piece) for piece, _ in self.split(self.normalise(part)) if piece]
        return out

    def word(self, word: str) -> list[int]:
        return [int(i) for p in self.parts(word) for i in p[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)

    def entry(self, raw: bytes) -> tuple[str, str, int]:
        """(ids, vocabulary strings, number of ids) of a word."""
        p = self.parts(raw.decode())
        if len(p) == 1:
            return p[0]
        p = [x for x in p if x[2]]
        return " ".join([x[0] for x in p]), " ".join([x[1] for x in p]), sum([x[2] for x in p])

    def clear(self) -> None:
        self.pieces.clear()
        self.known = pa.array([], pa.large_binary())
        self.id_s, self.dec_s = pa.array([], pa.string()), pa.array([], pa.string())
        self.size = np.zeros(0, np.int64)

    def places(self, vals: pa.Array) -> np.ndarray:
        """Where the distinct words' encodings are; new words are encoded first."""
        if len(self.known) > CACHE_WORDS or len(self.pieces) > CACHE_PIECES:
            self.clear()
        at = pc.index_in(vals, value_set=self.known)
        if at.null_count:
            fresh = vals.filter(pc.is_null(at))
            on = gc.isenabled()
            gc.disable()  # nothing below makes cycles
            try:
                got = [self.entry(w) for w in fresh.to_pylist()]
            finally:
                if on:
                    gc.enable()
            self.known = pa.concat_arrays([self.known, fresh])
            self.id_s = pa.concat_arrays([self.id_s, pa.array([g[0] for g in got], pa.string())])
            self.dec_s = pa.concat_arrays([self.dec_s, pa.array([g[1] for g in got], pa.string())])
            self.size = np.concatenate((self.size, np.array([g[2] for g in got], np.int64)))
            at = pc.index_in(vals, value_set=self.known)
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def encode(self, col) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Per text: number of tokens, decimal ids joined by a blank, decoded text."""
        idx, vals, per = W.batch_words(col, lower=False)
        at = self.places(vals)[idx] if len(idx) else np.zeros(0, np.int64)
        text_of = np.repeat(np.arange(len(per)), per)
        n = np.bincount(text_of, weights=self.size[at], minlength=len(per)).astype(np.int64) if len(at) else np.zeros(len(per), np.int64)
        if len(at) and not self.size[at].all():  # words that leave no token
            solid = self.size[at] > 0
            at, text_of = at[solid], text_of[solid]
        cuts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text_of, minlength=len(per))))), pa.int32())
        joined = [pc.binary_join(pa.ListArray.from_arrays(cuts, strings.take(pa.array(at))), " ") for strings in (self.id_s, self.dec_s)]
        return n, joined[0], joined[1]


def sha256_hex(col: pa.Array) -> pa.Array:
    data, off = W.text_bytes(col)
    view, cut = memoryview(np.ascontiguousarray(data)), off.tolist()
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string())


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256); with full also the ids and the decoded text."""
    ship_package(docs.sparkSession)
    more = ", ids string, decoded string" if full else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(tokenizer_path)
        for whole in batches:
            for b in W.slices(whole, 1):
                n, ids, dec = bpe.encode(b.column(1))
                cols = [b.column(0), pa.array(n, pa.int64()), sha256_hex(ids), sha256_hex(dec)]
                if full:
                    cols += [ids.cast(pa.string()), dec.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])
        bpe.clear()

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(lean(work), f"id {dict(src.dtypes)['id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("word_bpe_49k.json"))
