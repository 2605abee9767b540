"""Fill-in-middle, decontamination and source divergence against plain versions."""

import hashlib
import re

import numpy as np
import pytest

from tellurion.llm import op11_fim as M
from tellurion.llm import op12_decontaminate as C
from tellurion.llm import op13_divergence as D

MARKS = ("<P>", "<S>", "<M>")
#: Null, empty, short, marked, cut markers, blank lines, scripts, and texts over several chunks with characters across their edges.
TEXTS = [None, "", "a", "ab", "<P>x", "x <M>", "<", "<<S", "<P<S<M", "one two\nthree\n\n four", "日本語 テキスト。 😀 👍🏽", "é" * 40000, "x😀" * 50000, "word " * 70000, "a\n" * 66000, "y" * 200000 + "<S>", "z" * 65535 + "<M>" + "z" * 9, "<" * 70000]


def docs(spark, texts, **extra):
    return spark.createDataFrame([(i, t, "en", "src0", None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def plain_fim(doc_id, text, starts):
    """The contract in a few lines; starts: places where units begin."""
    t, x = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    places = [*starts(t), len(t)]
    n = len(places) - 1
    if not t or any(m in t for m in MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = places[lo], places[hi]
    pre, mid, suf = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", lo, hi - lo, f"<P>{pre}<S>{suf}<M>{mid}"


STARTS = {
    "code_points": lambda t: range(len(t)),
    "words": lambda t: [m.start() for m in re.finditer(r"[^ \t-\r]+", t)],
    "lines": lambda t: [m.start() for m in re.finditer(r"[^\n]*\n|[^\n]+", t)],
}


@pytest.mark.parametrize("unit", list(STARTS))
def test_fim_in_units(spark, unit):
    texts = TEXTS * 3  # other draws each time
    got = M.fill_in_middle(docs(spark, texts), unit=getattr(M, unit)())
    rows = {r["doc_id"]: r for r in got.withColumn("back", M.restore(got["output"], got["form"])).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_units"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) == plain_fim(i, t, STARTS[unit]), (i, unit)
        assert r["back"] == (t or "")


def test_fim_random_markers(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("<<<PSM>> é"), rng.integers(0, 9))) for _ in range(300)]
    rows = {r["doc_id"]: r for r in M.fill_in_middle(docs(spark, texts)).collect()}
    assert all((rows[i]["form"], rows[i]["output"]) == (w := plain_fim(i, t, STARTS["code_points"]))[1:2] + w[4:] for i, t in enumerate(texts))


def test_fim_rates_ids_and_odd_tables(spark):
    d = docs(spark, ["same text"] * 4)
    twice = d.unionByName(d).selectExpr("CASE WHEN doc_id < 2 THEN 7 WHEN doc_id = 2 THEN NULL ELSE doc_id END AS doc_id", "text", "1 AS form", "2 AS output", "3 AS __cut")
    rows = M.fill_in_middle(twice).collect()
    assert len(rows) == 8 and len({r["output"] for r in rows if r["doc_id"] == 7}) == 1
    assert next(r for r in rows if r["doc_id"] is None)["output"] == plain_fim(None, "same text", STARTS["code_points"])[4]
    assert M.fill_in_middle(d.limit(0)).collect() == []
    assert {r["form"] for r in M.fill_in_middle(d, transformed=0).collect()} == {"plain"}
    assert {r["form"] for r in M.fill_in_middle(d, transformed=100, suffix_first=100).collect()} == {"spm"}


@pytest.mark.parametrize("unit", list(STARTS))
def test_blocks_compose_like_one_scan(unit):
    auto = M.automaton(getattr(M, unit)())
    text = ("ab <S é\n\n" * 300 + "<P>" + "x\n" * 200).encode()
    data = auto.classes[np.frombuffer(text, np.uint8)]
    off = np.array([0, 5, 5, 1000, len(text)])
    start, length, sizes = M.blocks_of(off)
    state, units = M.prefixes(*M.scan(auto, data, start, length), sizes)
    for k, (a, b) in enumerate(zip(off, off[1:], strict=False)):
        for s in range(len(auto.step)):
            at, n = s, 0
            for c in data[a:b]:
                n += int(auto.begins[at, c])
                at = auto.step[at, c]
            j = np.cumsum(sizes)[k] - 1
            assert (state[j, s], units[j, s]) == (at, n)


# Decontamination ---------------------------------------------------------------------

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain_leaks(texts, items, window=10):
    """id -> (words, words hit, items hit), window by window."""
    where = {}
    for item, text, *_ in items:
        w = words_of(text)
        m = min(len(w), window)
        for i in range(len(w) - m + 1 if m else 0):
            where.setdefault(tuple(w[i : i + m]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, got = words_of(text), set(), set()
        for m in {len(k) for k in where}:
            for i in range(len(w) - m + 1):
                if (found := where.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    got |= found
        out.append((len(w), len(hit), sorted(got)))
    return out


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, window string")


LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30000))
ITEMS = [
    (1, "The Quick-brown fox jumps over the lazy dog, and then it sleeps again", None),
    (2, "quick brown fox jumps over the lazy dog and then it", None),
    (3, "École ÉTUDE x1", None),
    (4, "one", None),
    (5, None, None),
    (6, " ,;: ", None),
    (7, "the the the the the the the the the the the the", None),
    (None, "no id here but there are ten words in it all", None),
    (2, "a second text of the second item that has ten words", None),
    (11, " ".join(LONG.split()[500:530]), None),
    (12, "a b c d e f g", None),
]
LEAKS = [
    None, "", "...", "one", "ONE, two", "the quick brown fox jumps over the lazy dog and then it sleeps again", "x the quick brown fox jumps over the lazy cat", "É cole école Étude x1 École ÉTUDE x1",
    "the " * 40, "the " * 9, LONG, "No id here. But THERE are ten\nwords in it\x00all, one", "d e f g", "z a b c d e f g a b c d e f g", "a second text of the second item that has ten", "quick brown fox jumps over the lazy dog and then it sleeps",
    "Quick brown fox jumps over the lazy dog, and then it " * 3,
]


def test_leaks_against_plain_windows(spark):
    texts = LEAKS + LEAKS[:6]
    d = spark.createDataFrame([(i % 20, t, 1, 2) for i, t in enumerate(texts)], "doc_id int, text string, window int, h int")
    got = C.decontaminate(d, items(spark, ITEMS)).collect()
    want = [(i % 20, *x) for i, x in enumerate(plain_leaks(texts, ITEMS))]
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)
    spans = C.occurrences(d, items(spark, ITEMS)).collect()
    w = {i: words_of(t) for i, t in enumerate(texts[:20])}
    assert all(r["doc_id"] < len(texts) - 20 or " ".join(w[r["doc_id"]][r["start"] : r["start"] + r["m"]]) == r["window"] for r in spans) and spans


@pytest.mark.parametrize("window", [1, 3, 5, 6])
def test_leaks_random_few_words(spark, window):
    """Few distinct words: every shingle is common, and windows overlap all over."""
    rng = np.random.default_rng(window)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 40))) for _ in range(60)]
    bench = [(int(i), " ".join(rng.choice(list("abc"), rng.integers(0, 2 * window + 2))), None) for i in range(8)]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in C.decontaminate(docs(spark, texts), items(spark, bench), window=window).collect()}
    assert [got[i] for i in range(len(texts))] == plain_leaks(texts, bench, window)


def test_leaks_of_a_full_bit_map(spark, monkeypatch):
    """A map far too small lets every place through; the join alone decides."""
    monkeypatch.setattr(C, "BITS", 6)
    monkeypatch.setattr(C, "FEWEST_BITS", 6)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in C.decontaminate(docs(spark, LEAKS), items(spark, ITEMS)).collect()}
    assert [got[i] for i in range(len(LEAKS))] == plain_leaks(LEAKS, ITEMS)


def test_leaks_of_empty_tables(spark):
    some, none = items(spark, ITEMS), items(spark, ITEMS).limit(0)
    assert C.decontaminate(docs(spark, LEAKS).limit(0), some).collect() == []
    for bench in (none, items(spark, [(1, None, None), (2, "", None)])):
        rows = C.decontaminate(docs(spark, ["a b", None]), bench).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows) == [(0, 2, 0, [], False), (1, 0, 0, [], False)]


def test_leaks_run_no_python(spark, sf_dir):
    places = C._places(spark.read.parquet(f"{sf_dir}/documents.parquet"), C._shingles(C.windows(spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("window", "m").distinct()), "doc_id", "text", 10)
    plan = places._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Divergence ------------------------------------------------------------------------------


def plain_audit(rows, least=30, top=50):
    """The contract with plain dictionaries, every pair of groups term by term."""
    count, groups, has = {}, {}, {}
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups[g] = 1
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        for t in terms:
            count[(*g, t)] = count.get((*g, t), 0) + 1
        for t in set(terms):
            has[g[0], t] = has.get((g[0], t), 0) + 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in has.items() if x == lang and n >= least)
        of = {s: {t: count.get((lang, s, t), 0) for t in kept} for x, s in groups if x == lang}
        total = {t: sum(c[t] for c in of.values()) for t in kept}
        weigh = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: weigh(c) for s, c in of.items()}, weigh(total)
        for s in of:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in of if o != s)
            above = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if of[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, x[2], -x[0], i + 1) for part, found in (("pair", pairs), ("term", above)) for i, x in enumerate(found)]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus_rows():
    rng = np.random.default_rng(11)
    names = [f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "é", "ß", "日本"]
    rows = []
    for i in range(400):
        lang, source = ("en", "de", None, "fr")[i % 4], ("hot", "hot", "a", "b", None, "c")[i % 6]
        weights = rng.dirichlet(np.full(len(names), 0.3))
        rows.append((", ".join(rng.choice(names, rng.integers(0, 200), p=weights)).upper() if i % 3 else " ".join(rng.choice(names, 90, p=weights)), lang, source))
    return [*rows, (None, "en", "empty"), ("", "en", "blank"), ("1 2 3", "xx", "digits"), (None, "xx", "none"), ("lonely word", "yy", "one"), ("termaa " * 50000, "en", "long")]


def test_divergence_against_plain_counts(spark):
    rows = corpus_rows()
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, value int").repartition(5)
    got = audited(D.audit(d))
    assert got == plain_audit(rows)
    assert sum(r[2] == "pair" for r in got) and max(r[5] for r in got if r[2] == "term") > 20
    assert audited(D.audit(d, least_docs=1, top=3)) == plain_audit(rows, 1, 3)


def test_divergence_of_ties_and_nothing(spark):
    same = [("b a c", "en", s) for s in ("x", "y", "z") for _ in range(30)]
    assert audited(D.audit(spark.createDataFrame(same, "text string, lang string, source string"))) == plain_audit(same)
    assert D.audit(spark.createDataFrame(same, "text string, lang string, source string").limit(0)).collect() == []


def test_divergence_is_exact_for_counts_beyond_64_bits(spark):
    big, total, v = 9_000_000_000_000_000, 10_000_000_000_000_001, 77
    r = spark.createDataFrame([(big, total, v)], "c bigint, n bigint, v bigint").select(D._weight("c", "n", "v").alias("p")).first()
    assert r["p"] == 1 + 10**9 * (big + 5) // (total + 5 * v)


def test_pair_tallies_in_small_rounds(spark, monkeypatch):
    """Tallies come out in parts and add up."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    cells = [[{"source": s, "n": int(rng.integers(1, 4))} for s in sorted(rng.choice(list("abcdefg"), rng.integers(0, 7), replace=False))] for _ in range(200)]
    lang = pa.array([("en", "de")[i % 2] for i in range(200)])
    want = {}
    for g, c in zip(lang.to_pylist(), cells, strict=True):
        for i, x in enumerate(c):
            for y in c[i + 1 :]:
                k = (g, x["source"], y["source"], x["n"], y["n"])
                want[k] = want.get(k, 0) + 1
    for most in (10, 1 << 20):
        monkeypatch.setattr(D, "TALLIED", most)
        got = {}
        for b in D.tally_pairs(lang, pa.array(cells, pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))):
            for r in b.to_pylist():
                k = (r["lang"], r["a"], r["b"], r["ca"], r["cb"])
                got[k] = got.get(k, 0) + r["m"]
        assert got == want


@pytest.mark.parametrize("name", ["op11_fim", "op12_decontaminate", "op13_divergence"])
def test_new_queries_against_sql(spark, sf_dir, name):
    import duckdb

    from tellurion.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, rel = QUERIES[name](spark, sf_dir), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, df.select(*rel.columns).collect()), key=key) == sorted(rel.fetchall(), key=key)
