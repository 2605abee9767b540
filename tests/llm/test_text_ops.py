"""Operators on texts: brute force, libraries, and odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tellurion.llm import op1_url_filter as U
from tellurion.llm import op2_ngram_join as J
from tellurion.llm import op3_gru_lm as L
from tellurion.llm import op5_quality as Q
from tellurion.llm import op6_toxicity as X
from tellurion.llm import op7_packing as K
from tellurion.llm import op8_bpe as B
from tellurion.llm import op10_pii as I
from tellurion.llm import words as W

#: Null, empty, blank, very long, odd spaces and scripts, special tokens, ties and repeats.
ODD = [None, "", "  \n", "word", "a b c d e f g", "a b c d e f g", "x " * 30000, "don't  I'll 123 ½", "foo<|endoftext|> bar <|startoftext|>baz", "étude ΑΣ İstanbul ß", "日本語 テキスト。 😀 👍🏽", "a\u00a0b\u2003c \x85 d\x1ce", "q@r.st 1.2.3.4 +1 (555) 123-4567 4111 1111 1111 1111", "Z" * 50000]


def docs(spark, texts, **extra):
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    return d, {r["doc_id"]: r["text"] for r in d.collect()}


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_words_match_a_regular_expression():
    idx, vals, per = W.batch_words(pa.array(ODD))
    words = [v.as_py().decode() for v in vals]
    at = 0
    for t, n in zip(ODD, per.tolist(), strict=True):
        assert [words[i] for i in idx[at : at + n]] == tokens(t)
        at += n
    touching = pa.array(["ab", "cd", "", " e", "f "])
    idx, vals, per = W.batch_words(touching)
    assert [vals[i].as_py() for i in idx] == [b"ab", b"cd", b"e", b"f"] and per.tolist() == [1, 1, 0, 1, 1]
    assert len(set(W.hash_words(pa.array([b"", b"a", b"a\0", b"aaaaaaaa", b"aaaaaaaaa"], pa.large_binary())).tolist())) == 5


# URL filters ---------------------------------------------------------------------


@pytest.mark.parametrize("url, want", [
    (None, ("", "", None, "allow")), ("", ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("x://Com/en/1?q", ("com", "/en/1", "com/en/", "block")),
    ("http://A.EXAMPLE.com/en/77#x", ("a.example.com", "/en/77", "example.com/en/7", "allow")), ("http://xexample.net/de/8", ("xexample.net", "/de/8", "net/de/", "block")),
    ("http://example.net/de/8", ("example.net", "/de/8", "example.net/de/8", "block")), ("http://host?x.com/en/", ("host", "", None, "allow")), ("http://a.org/EN/es/", ("a.org", "/EN/es/", None, "allow")),
    ("http://www.casino-win.example.org/x", ("www.casino-win.example.org", "/x", None, "block")),
])
def test_url(url, want):
    rules = U.HOST_PATH_RULES + U.PATTERN_RULES
    index = U.RuleIndex(rules, {})
    assert index.judge(url, index.compiled()) == want


def test_url_rules_are_those_of_the_contract():
    """Each rule's word by itself, and the longest rule against a shorter one with the other word."""
    assert [(r.name, r.action) for r in U.HOST_PATH_RULES] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    index = U.RuleIndex(U.HOST_PATH_RULES + U.PATTERN_RULES, {})
    rx = index.compiled()
    judged = {u: index.judge(u, rx)[2:] for u in ("http://casino-win.net/de/1", "http://www.net/de/8", "http://sub.example.net/de/81", "http://example.net/de/7")}
    assert judged == {"http://casino-win.net/de/1": ("net/de/", "allow"), "http://www.net/de/8": ("net/de/", "allow"), "http://sub.example.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow")}


def test_rule_index_loses_nothing():
    rng = random.Random(3)
    parts = ["ads", "x", "track", "img", "a1", "b-c"]
    rules = [U.Rule(rng.choice(["", "||", "|http", "/"]) + rng.choice(["*", "/", ".", ""]).join(rng.sample(parts, 2)) + rng.choice(["/", "^", "*", ""]), rng.choice(["block", "allow"])) for _ in range(60)]
    index = U.RuleIndex(rules, {"ads": 100, "x": 5})
    rx = index.compiled()
    for _ in range(400):
        url = "http://" + ".".join(rng.sample(parts, 2)) + "/" + "/".join(rng.sample(parts, 3)) + rng.choice(["", "?x=1"])
        host, path, rest = U.split_url(url)
        fits = [i for i, r in enumerate(rx) if r.search(host + path + rest)]
        slim = {i for t in set(re.findall(r"[a-z0-9]+", (host + path + rest).lower())) for i in index.by_token.get(t, ())} | set(index.always)
        assert set(fits) <= slim


def test_url_table(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/1", "h"), (1, "http://a.com/en/1", "h"), (None, None, None)], "page_id bigint, url string, host string")
    got = U.filter_urls(df, U.HOST_PATH_RULES, "page_id", "url").collect()
    assert len(got) == 3 and sum(r["verdict"] == "block" for r in got) == 2
    assert U.filter_urls(df.limit(0), U.HOST_PATH_RULES, "page_id", "url").count() == 0


# n-gram join ------------------------------------------------------------------------


def brute_components(texts, k, limit):
    sets = {}
    for i, t in texts.items():
        w = tokens(t)
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    inv = collections.defaultdict(list)
    for i in sorted(sets):
        seen = collections.Counter(j for g in sets[i] for j in inv[g])
        for j, o in seen.items():
            if 100 * o >= limit * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
        for g in sets[i]:
            inv[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n_base=6, copies=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.sample(words, 40)
    out = []
    for b in range(n_base):
        base = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            if b % 2:
                t = passage + t
            out.append(" ".join(t))
        out.append(" ".join(base))
        out.append(" ".join(base).upper().replace(" ", " \n", 3))
    return out + ODD


@pytest.mark.parametrize("k, limit", [(4, 85), (5, 80)])
def test_components_are_exact(spark, monkeypatch, k, limit):
    texts = near_copies(k)
    want = brute_components(dict(enumerate(texts)), k, limit)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(docs(spark, texts), k, limit).collect()}
    assert got == want
    monkeypatch.setattr(J, "BLOCK", 8)  # block pairs, and lists taken as heavy early
    monkeypatch.setattr(J, "LONG", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(docs(spark, texts), k, limit).collect()}
    assert got == want


def test_components_without_rows_or_ids(spark):
    assert J.components(docs(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in J.components(df).collect()) == [(False, 5), (False, 5), (True, 5)]


def test_null_ids_bridge_and_ids_repeat(spark):
    """Links A - B - C where B has no id, and one id on two different texts."""
    words = [f"w{i}" for i in range(80)]
    b = words.copy()
    a, c = ["x", "y", *b[2:]], [*b[:-2], "u", "v"]
    other = [f"o{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (None, " ".join(b)), (3, " ".join(c)), (3, " ".join(other)), (2, " ".join([*other[:-1], "z"])), (None, "p q r s t"), (None, "p q r s t")]
    got = J.components(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 90).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == sorted([(1, 77, 1), (0, 77, 1), (3, 77, 1), (3, 57, 2), (2, 57, 2), (0, 2, 0), (0, 2, 0)])


def test_shingle_parts_grow_with_the_rows():
    assert [J.part_bits(n) for n in (0, 10**6, 8000 << 12, 10**12)] == [9, 9, 12, 16]
    rng = np.random.default_rng(0)
    rising = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    cut = J._cuts(rising, 10)
    assert len(cut) == 1025 and all(((rising[cut[p] : cut[p + 1]] >> np.uint64(54)) == p).all() for p in range(1024))


def test_divide_skip_and_merge():
    rng = np.random.default_rng(0)
    lists = [np.sort(rng.choice(60, rng.integers(1, 12), replace=False)) for _ in range(6)]
    for least in (1, 2, 3):
        c = collections.Counter(np.concatenate(lists).tolist())
        assert J.merge_lists(lists, least).tolist() == sorted(v for v, n in c.items() if n >= least)
        assert J.merge_lists(lists * 3, 3 * least).tolist() == sorted(v for v, n in c.items() if n >= least)


# language model ------------------------------------------------------------------------


def test_language_model(spark, corpus):
    d, texts = corpus
    count = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*tokens(t), None])
    n, v = sum(count.values()), len(count)
    rows = L.score_documents(d).collect()
    for r in rows:
        t = [*tokens(texts[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_gradients():
    rng = np.random.default_rng(1)
    lex = L.make_lexicon(np.arange(10, 60), np.arange(50, 0, -1), np.full(L.RARE, 2000.0), np.full(L.RARE, 60.0), np.zeros(50, int), 9, 2000, 90)
    p = {k: v.astype(np.float64) for k, v in L.start_params(lex).items()}
    x = rng.integers(0, len(lex.word_class), (3, 5))
    word = rng.integers(0, 51, 15)
    cls = lex.word_class[word]

    def loss():
        states, _ = L.run_window(p, x, np.zeros((3, L.HIDDEN)))
        return -L.outputs(p, lex, states.reshape(15, -1).astype(np.float64), cls, word)[0].sum()

    grads = {k: np.zeros_like(v) for k, v in p.items()}
    states, kept = L.run_window(p, x, np.zeros((3, L.HIDDEN)))
    _, dh = L.outputs(p, lex, states.reshape(15, -1).astype(np.float64), cls, word, grads)
    L.back_window(p, x, kept, dh.reshape(3, 5, -1), grads)
    for k in p:
        i = tuple(rng.integers(0, s) for s in p[k].shape) if k != "emb" else (x[0, 0], 3)
        old, e = p[k][i], 1e-2
        p[k][i] = old + e
        up = loss()
        p[k][i] = old - e
        down = loss()
        p[k][i] = old
        assert math.isclose((up - down) / (2 * e), grads[k][i], rel_tol=3e-2, abs_tol=3e-3), k


def test_model_state_is_carried_and_sums_to_one():
    lex = L.make_lexicon(np.arange(10, 60), np.arange(50, 0, -1), np.full(L.RARE, 2000.0), np.full(L.RARE, 60.0), np.zeros(50, int), 9, 2000, 90)
    p = L.start_params(lex)
    h = np.random.default_rng(2).normal(size=(1, L.HIDDEN)).astype(np.float32)
    every = np.arange(len(lex.word_class))
    rep = np.repeat(h, len(every), 0)
    inside = np.exp(L.outputs(p, lex, rep, lex.word_class, every)[0]).sum()
    rare = np.exp(L.outputs(p, lex, np.repeat(h, L.RARE, 0), 1 + L.CLASSES + np.arange(L.RARE), np.full(L.RARE, -1))[0]).sum()
    assert math.isclose(inside + rare, 1, rel_tol=1e-4)
    n = 3 * L.STEPS + 5
    word = np.random.default_rng(3).integers(1, 51, n)
    whole = L.text_logs(p, lex, np.array([n, 0]), np.arange(n), lex.word_class[word], word, word)
    start, length, c, w, x = L._layout(np.array([n]), np.arange(n), lex.word_class[word], word, word, len(lex.word_class))
    states, _ = L.run_window(p, x[None, :], np.zeros((1, L.HIDDEN), np.float32))
    assert math.isclose(whole[0], L.outputs(p, lex, states[0], c, w)[0].sum(), rel_tol=1e-4)


def test_model_in_a_used_room_and_against_plain_softmax():
    """Windows of other shapes in one room, with steep logits too: states as in a fresh one, probabilities and gradients as worked out plainly."""
    lex = L.make_lexicon(np.arange(10, 60), np.arange(50, 0, -1), np.full(L.RARE, 2000.0), np.full(L.RARE, 60.0), np.zeros(50, int), 9, 2000, 90)
    cls, word, _ = L.code_tables(lex)
    rng, room = np.random.default_rng(5), L.Room()
    for rows, steps, factor in ((40, L.STEPS, 1), (3, 5, 40), (7, L.STEPS, 4000)):
        p = {k: v.astype(np.float64) * (factor if k in ("wo", "wc") else 1) for k, v in L.start_params(lex).items()}
        x = rng.integers(0, len(cls), (rows, steps))
        h = rng.uniform(-1, 1, (rows, L.HIDDEN))
        fresh, kept = L.run_window(p, x, h)
        lean = L.run_window(p, x, h, False, room)[0].copy()
        states, kept_here = L.run_window(p, x, h, room=room)
        assert np.array_equal(fresh, states) and np.array_equal(fresh, lean)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        here = {k: np.zeros_like(v) for k, v in p.items()}
        flat, code = fresh.reshape(-1, L.HIDDEN), x.ravel()
        got, dh = L.outputs(p, lex, flat, cls[code], word[code], here, room)
        logits = flat @ p["wc"] + p["bc"]
        for i, c in enumerate(code):
            k = cls[c]
            share = np.exp(logits[i] - logits[i].max()) / np.exp(logits[i] - logits[i].max()).sum()
            want, back = np.log(share[k]), p["wc"] @ share - p["wc"][:, k]
            grads["bc"] += share
            grads["bc"][k] -= 1
            if word[c] >= 0:
                a, b = lex.class_start[k], lex.class_start[k + 1]
                inside = p["wo"][a:b] @ flat[i] + p["bo"][a:b]
                share = np.exp(inside - inside.max()) / np.exp(inside - inside.max()).sum()
                want, back = want + np.log(share[word[c] - a]), back + share @ p["wo"][a:b] - p["wo"][word[c]]
                grads["bo"][a:b] += share
                grads["bo"][word[c]] -= 1
            assert math.isclose(got[i], want, rel_tol=1e-6, abs_tol=1e-5) and np.allclose(dh[i], back, rtol=1e-6, atol=1e-5 * factor)
        assert all(np.allclose(here[k], grads[k], atol=1e-5) for k in ("bc", "bo"))
        L.back_window(p, x, kept, dh.reshape(rows, steps, -1), grads)
        L.back_window(p, x, kept_here, dh.reshape(rows, steps, -1), here, room)
        assert all(np.array_equal(here[k], grads[k]) for k in ("u", "wx", "bx", "emb"))


def test_outputs_of_tokens_on_some_rows():
    """Classes of many words against a plain softmax; tokens that stand on chosen rows, in any order, as those rows alone; rows without a token get no gradient."""
    n_words = 900
    lex = L.make_lexicon(np.arange(10, 10 + n_words), 9000 // np.arange(1, 1 + n_words), np.full(L.RARE, 90000.0), np.full(L.RARE, 1000.0), np.zeros(n_words, int), 9, 90000, 2000)
    assert np.diff(lex.class_start).max() > 20
    cls, word, _ = L.code_tables(lex)
    rng, room = np.random.default_rng(8), L.Room()
    p = {k: v.astype(np.float64) for k, v in L.start_params(lex).items()}
    p["wo"] *= 30
    h = rng.uniform(-1, 1, (3 * L.OUTPUT_ROWS, L.HIDDEN))
    for n in (2 * L.OUTPUT_ROWS + 5, 3, 0):
        at, code = rng.permutation(len(h))[:n], rng.integers(0, len(cls), n)
        alone, some, plain = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(3))
        want, back = (v.copy() for v in L.outputs(p, lex, h[at], cls[code], word[code], alone))
        got, dh = L.outputs(p, lex, h, cls[code], word[code], some, room, at)
        assert np.allclose(got, want) and np.allclose(dh[at], back) and not np.delete(dh, at, 0).any()
        assert all(np.allclose(alone[k], some[k]) for k in p)
        for i, c in zip(at, code, strict=True):
            if word[c] >= 0:
                a, b = lex.class_start[cls[c]], lex.class_start[cls[c] + 1]
                share = np.exp(p["wo"][a:b] @ h[i] + p["bo"][a:b])
                share /= share.sum()
                share[word[c] - a] -= 1
                plain["wo"][a:b] += share[:, None] * h[i]
                plain["bo"][a:b] += share
        assert all(np.allclose(plain[k], some[k]) for k in ("wo", "bo")) and bool(n) == some["bo"].any()
        q = {k: v.copy() for k, v in p.items()}
        L.Adam(q, 0.01).step(q, some, np.zeros(0, int), max(n, 1))
        assert not some["wo"].any() and not some["bo"].any() and bool(n) == (q["wo"] != p["wo"]).any() == (q["bo"] != p["bo"]).any()


def test_language_model_on_odd_input(spark):
    got = {r["doc_id"]: r for r in L.score_documents(docs(spark, ODD)).collect()}
    assert len(got) == len(ODD) and all(math.isfinite(r["score"]) for r in got.values()) and got[0]["n_tokens"] == 1
    assert L.score_documents(docs(spark, [])).count() == 0


# classifiers -------------------------------------------------------------------------------


def test_toxicity_trains_on_all_passages_of_long_texts():
    """Every passage of a text of 500 is there, and the one with other words is the worst under a model of them."""
    words = [f"plain{i % 90}" for i in range(500 * X.WINDOW)]
    value = np.zeros(X.BUCKETS)
    value[X.gram_buckets(pa.array(["vile"], pa.large_string()))[0]] = 5.0
    for k in (0, 250, 499):
        text = words.copy()
        text[k * X.WINDOW : k * X.WINDOW + 3] = ["vile"] * 3
        bags = X.collect(pa.array(["other words", " ".join(text), "", *[f"vile {i}" for i in range(3)]], pa.string()))
        assert np.bincount(bags.text, minlength=6).tolist() == [1, 500, 0, 1, 1, 1]
        assert int(np.argmax(bags.logits(value)[bags.text == 1])) == k


def test_toxicity_scores_against_plain_averages():
    """A fitted model's scores, recomputed word by word from n-gram strings."""
    rng = random.Random(2)
    clean = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 90))) for _ in range(80)]
    model = X.fit(pa.array([t + " scoundrel scoundrels" if i % 2 else t for i, t in enumerate(clean)]), np.arange(80) % 2)
    texts = [clean[0], clean[1] + " sc0undrel", "Scoundrel", "", "a a a a", "é scoundrel " * 40]

    def word_value(w):
        bucket, n = X.gram_buckets(pa.array([w.encode()], pa.large_binary()))
        marked = b"\x01" + w.encode() + b"\x02"
        assert n[0] == 1 + sum(max(len(marked) - k + 1, 0) for k in X.GRAMS)
        return model.value[bucket].sum() / n[0]

    for t, got in zip(texts, model.scores(pa.array(texts)), strict=True):
        w = tokens(t)
        parts = [sorted(set(w[i : i + X.WINDOW])) for i in range(0, len(w), X.WINDOW)]
        worst = max((sum(map(word_value, p)) / max(len(p), X.LEAST_WORDS) for p in parts), default=0.0) + model.bias
        assert math.isclose(got, 1 / (1 + math.exp(-(model.slope * worst + model.offset))), rel_tol=1e-9)


def test_gru_learns_from_every_window():
    lex = L.make_lexicon(np.arange(10, 60), np.arange(50, 0, -1), np.full(L.RARE, 2000.0), np.full(L.RARE, 60.0), np.zeros(50, int), 9, 2000, 90)
    p = L.start_params(lex)
    per = np.array([40 * L.STEPS + 3, 0, 5, 8 * L.STEPS])
    idx = np.arange(int(per.sum())) % 50
    word = 1 + np.arange(50)
    assert L.train_texts(p, lex, L.Adam(p, 0.01), per, idx, lex.word_class[word], word, word) == (per + 1).sum()
    assert len(L.make_lexicon(np.arange(9000), np.arange(9000, 0, -1), np.full(L.RARE, 1e8), np.full(L.RARE, 1e4), np.zeros(9000, int), 9, 10**8, 10**5).words) == 9000


def test_quality_and_toxicity_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    d, lab = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    for score, label, most in ((Q.score_documents(d, Q.train(d, lab)), "quality", 0.02), (X.score_documents(d, X.train(d, lab)), "toxic", 0.07)):
        rows = score.join(lab, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).collect()
        assert len(rows) > 60 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
        assert np.mean([r["predicted"] != r["y"] for r in rows]) <= most
        pos, neg = [r["score"] for r in rows if r["y"] == 1], [r["score"] for r in rows if r["y"] == 0]
        assert np.mean([a > b for a in pos for b in neg]) > 0.9


@pytest.mark.parametrize("op", [Q, X])
def test_classifiers_on_odd_input(spark, op):
    d = docs(spark, ODD * 3)
    lab = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    for labels in (lab, lab.limit(0), lab.where("quality = 1")):
        got = op.score_documents(d, op.train(d, labels)).collect()
        assert len(got) == len(ODD) * 3 and all(0 <= r["score"] <= 1 for r in got)
    model = op.train(d, lab.limit(0))
    assert {r["score"] for r in op.score_documents(d, model).collect()} == {0.5}
    assert op.score_documents(d.limit(0), model).count() == 0
    kept = op.score_documents(d, model, keep=True)
    assert kept.columns[: len(d.columns)] == d.columns
    with pytest.raises(ValueError):
        op.score_documents(d.withColumn("__text", F.lit(1)), model, keep=True)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = Q.fit(x, y)
    assert (0, 1) in model.pairs and ((model.scores(x) > 0.5) == y).mean() > 0.9


def test_misspellings_share_subwords():
    rng = random.Random(1)
    clean = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(30)) for _ in range(120)]
    texts = [t + " scoundrel scoundrels" if i % 2 else t for i, t in enumerate(clean)]
    model = X.fit(pa.array(texts), np.arange(120) % 2)
    bad, good = model.logits(pa.array([clean[0] + " sc0undrel scoundrell", clean[0] + " wonderful"]))
    assert bad > good


# packing -------------------------------------------------------------------------------------


def brute_bins(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms), sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 150))]
    bins = collections.defaultdict(list)
    for n, r0, r1, b0, per, at in K.plan(collections.Counter(lengths), cap):
        for r in range(r1 - r0):
            bins[b0 + r // per].append((at + r % per * n, n))
    for parts in bins.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
    assert brute_bins(lengths, cap) == (len(bins), sorted(cap - sum(n for _, n in p) for p in bins.values()))


def test_unit_ids_of_random_unicode_are_the_librarys():
    """White space of every kind, contractions, special tokens, scripts: 20,000 strings through one encoder whose cache overflows."""
    enc = K.UnitEncoder(K.tokenizer_file("byte_bpe_50k.json"))
    rng = random.Random(7)
    spaces = [chr(c) for c in (9, 10, 11, 12, 13, 32, 32, 0x1C, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    some = [*spaces, *"abéß日İI'’.,!12½\u0301😀", "'s", "'ll", "<|endoftext|>", " the", " a"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(16000)]
    texts += ["".join(chr(rng.randrange(1, 0x3100)) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    texts += ["\xa0\xa0x", "\xa0 x", "a\xa0\n\nb", "x" * 300000 + "\u3000" * 50000 + " y", "\u2003" * 7, None]
    for _ in range(2):
        ids, per = enc.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in enc.tok.encode(t or "", add_special_tokens=False).ids] and len(per) == len(texts)
        enc.known = pa.concat_arrays([enc.known, pa.array([b"\0" * K.CACHE_BYTES], pa.large_binary())])


def check_packing(rows, texts, tokenizer, capacity):
    per_doc, per_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        per_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(per_doc) == set(texts)
    lengths = []
    for i, parts in per_doc.items():
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, K.END_ID]
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert sum(r["length"] for r in parts) == len(ids) and all(r["length"] == capacity for r in parts[1:])
        for r in parts:
            mine = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(mine) == r["length"] and zlib.crc32(mine.tobytes()) == r["ids_crc32"]
            lengths.append(r["length"])
    for parts in per_bin.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= capacity
    assert len(per_bin) == brute_bins(lengths, capacity)[0]


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = K.tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    d, texts = corpus
    check_packing(K.pack_documents(d, path).collect(), texts, tok, 1024)
    check_packing(K.pack_documents(docs(spark, ODD), path, capacity=100).collect(), dict(enumerate(ODD)), tok, 100)
    assert K.pack_documents(docs(spark, []), path).count() == 0
    twice = docs(spark, ["a b"]).unionAll(docs(spark, ["a b"]))
    assert K.pack_documents(twice, path).count() == 2


# BPE -----------------------------------------------------------------------------------------


def test_bpe_round_trip(spark, corpus):
    from tokenizers import Tokenizer

    path = K.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    d, texts = corpus
    for df, want in ((d, texts), (docs(spark, ODD), dict(enumerate(ODD)))):
        rows = B.encode_documents(df, path, full=True).collect()
        assert len(rows) == len(want)
        for r in rows:
            ids = tok.encode(want[r["doc_id"]] or "", add_special_tokens=False).ids
            text = tok.decode(ids, skip_special_tokens=False)
            assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), " ".join(map(str, ids)), text)
            assert r["ids_sha256"] == hashlib.sha256(r["ids"].encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert B.encode_documents(docs(spark, []), path).count() == 0


# personal data ----------------------------------------------------------------------------------


def brute_spans(text):
    out, text = [], text or ""

    def luhn(d):
        d = [int(c) for c in d][::-1]
        return sum(c if i % 2 == 0 else c * 2 - 9 * (c > 4) for i, c in enumerate(d)) % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for kind, rx, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m.group())
            if low <= len(d) <= high and (kind == 3 or luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{I.KINDS[k]}:{a}:{e}" for a, k, e in spans)


TRICKY = [*ODD, "a@b.cx_y@z.w", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.004", "+1 (555) 123-4567+44 20 7946 0958 99", "😀 x@y.z é 4111-1111-1111-1111", "aa@ @b.c a@b a@.b", "1" * 3000, "1.2." * 500, "9 " * 2000, "a." * 3000 + "@"]


def test_spans_against_regular_expressions(spark, corpus):
    d, texts = corpus
    for df, want in ((d, texts), (docs(spark, TRICKY), dict(enumerate(TRICKY)))):
        rows = I.find_spans(df).collect()
        assert len(rows) == len(want)
        for r in rows:
            b = brute_spans(want[r["doc_id"]])
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in b) for i in range(4)]
            assert r["base_sha256"] == hashlib.sha256(listed(b).encode()).hexdigest()
            assert set(listed(b).split(",")) <= set(r["spans"].split(","))
    assert I.find_spans(docs(spark, [])).count() == 0


def test_texts_with_many_matches(spark):
    """Matches are placed in runs: none of them, one, whole runs and parts of runs."""
    texts = [" ".join(f"user{i}@mail{i}.org 10.0.{i % 256}.7," for i in range(n)) for n in (0, 1, I.RUN - 1, I.RUN, I.RUN + 1, 2 * I.RUN, 2 * I.RUN + 1, 20000)]
    for r in I.find_spans(docs(spark, texts)).collect():
        want = listed(brute_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(r["spans"].split(","))


def test_contexts_discover_unseen_identifiers(spark):
    texts = [f"please write to me at user{i}@mail{i}.example.com thanks" for i in range(8)] + ["please write to me at handle77#x thanks", "the number 123456 means nothing at all"]
    got = {r["doc_id"]: r["spans"] for r in I.find_spans(docs(spark, texts)).collect()}
    assert got[8] == "id:22:32" or got[8].startswith("id:22:")
    assert got[9] == "" and got[0].startswith("email:22:")
    clean = {r["doc_id"]: r["text"] for r in I.redact(docs(spark, texts)).collect()}
    assert clean[0] == "please write to me at [EMAIL] thanks" and "[ID]" in clean[8] and clean[9] == texts[9]


def test_contexts_of_long_words(spark):
    """Two contexts that differ only far left in an 80-letter word are two patterns."""
    a, b = "a" + "x" * 80, "b" + "x" * 80
    texts = [f"word {a} user{i}@mail.org end" for i in range(12)] + [f"word {a} code77-{i}x end" for i in range(2)] + [f"word {b} code88-{i}x end" for i in range(2)]
    got = [r["spans"] for r in I.find_spans(docs(spark, texts)).orderBy("doc_id").collect()]
    assert all("id:" in s for s in got[12:14]) and not any(got[14:])


def test_redaction(spark):
    d = docs(spark, TRICKY)
    out = {r["doc_id"]: r for r in I.redact(d).collect()}
    assert I.redact(d).columns == d.columns and out[0]["text"] is None and out[3]["text"] == "word"
    for i, t in enumerate(TRICKY):
        assert not any(k == 0 for _, k, _ in brute_spans(out[i]["text"])), t
    with pytest.raises(ValueError):
        I.redact(d.withColumn("__pii_x", F.lit(1)))


def found_ids(spark, texts):
    """Texts of the spans that only the method finds."""
    got = {r["doc_id"]: r["spans"] for r in I.find_spans(docs(spark, texts)).collect()}
    return {t[int(a) : int(b)] for i, t in enumerate(texts) for k, a, b in (s.split(":") for s in got[i].split(",") if s) if k == "id"}


CARDS = ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004", "3530111333300000", "4012888888881881"]


def test_pii_bootstrapping_settles(spark):
    """Six seeds and six others after the same words: trusted once scores have settled; four among a hundred never."""
    even = [f"paid with account {c} today" for c in CARDS] + [f"paid with account AB-{i}77-XY today" for i in range(6)]
    assert found_ids(spark, even) == {f"AB-{i}77-XY" for i in range(6)}
    few = [f"see also page {c}" for c in CARDS[:4]] + [f"see also page {i}" for i in range(100, 200)]
    assert found_ids(spark, few) == set()
    assert found_ids(spark, [f"paid with account {CARDS[0]}"] * 50 + ["paid with account AB-1277-XY"]) == set()


def test_pii_spans_with_blanks_are_one_instance_each(spark):
    phones = [f"please call me +49 170 123456{i} soon" for i in range(6)]
    assert found_ids(spark, [*phones, "please call me x0170-55123 soon"]) == {"x0170-55123"}


def test_pii_backs_off_to_cues_and_labels(spark):
    """One word that ends in a cue, or a label glued to the value, is a pattern whatever stands before it."""
    a = [f"word{chr(97 + i)} account: {c}" for i, c in enumerate(CARDS)] + ["some other account: 99-AB-7", "the account 12-CD-8"]
    assert found_ids(spark, a) == {"99-AB-7"}
    b = [f"word{chr(97 + i)} acct={c} end" for i, c in enumerate(CARDS)] + ["elsewhere acct=QZ-18-77, end", "acct QZ-18-78"]
    assert found_ids(spark, b) == {"QZ-18-77"}


def test_pii_keys_are_seeds(spark):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(8)]
    texts = [f'x{i % 3}y\ntoken = "{k}"' for i, k in enumerate(keys)] + ['z\ntoken = "Zq81-unusual_Value9"', f"a commit {keys[0][::-1]} alone"]
    assert found_ids(spark, texts) == {*keys, "Zq81-unusual_Value9"}


def test_pii_found_instances_seed_others(spark):
    """Instances of a trusted pattern make another pattern trusted, which has no seed of its own."""
    first = [f"customer account no. {c}" for c in CARDS] + [f"customer account no. K{i}4-{i}" for i in range(5)]
    second = [f"refer to file K{i}4-{i}" for i in range(5)] + ["refer to file W99-1"]
    assert found_ids(spark, first + second) == {*(f"K{i}4-{i}" for i in range(5)), "W99-1"}


def test_quality_scores_added_plainly(spark, sf_dir, corpus):
    """Every document's score, entry by entry from the lookup tables of features and pairs, text by text."""
    import bisect

    d, texts = corpus
    model = Q.train(d, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert model.tables and model.pairs
    some = {**dict(list(texts.items())[:60]), **{10**6 + i: t for i, t in enumerate(ODD)}}
    rows = spark.createDataFrame(list(some.items()), "doc_id bigint, text string")
    for r in Q.score_documents(rows, model).collect():
        x = Q.features(pa.array([some[r["doc_id"]]], pa.string()))[0].tolist()
        total = model.bias
        for v, edges, table in zip(x, model.edges, model.tables, strict=True):
            total += table[bisect.bisect_right(edges.tolist(), v)]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[bisect.bisect_right(model.pair_edges[i].tolist(), x[i])][bisect.bisect_right(model.pair_edges[j].tolist(), x[j])]
        score = 1 / (1 + math.exp(-min(max(total, -30), 30)))
        assert math.isclose(r["score"], score, rel_tol=1e-9) and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
