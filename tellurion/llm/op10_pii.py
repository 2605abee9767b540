"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find e-mail addresses, IPv4 numbers, cards and phones with their places. These are seeds; so are
strings of 32 hexadecimal digits or more, which are keys wherever they stand. Tokens with a digit or an at sign are the other instances; a base span
counts as one instance whole, whatever blanks it holds. An instance's lexical patterns are the two words left of it with a label glued to it like ``id=``,
and, where these end in a cue (``:``, ``=`` or ``#``), the last word and label alone.

Patterns and instances form a bipartite graph, of which patterns with LEAST_SEEDS different seeds are kept. A pattern's confidence is the mean score of its
instances (smoothed), an instance's score is DAMPING times that of its best pattern, seeds stay at 1. Scores go round until they settle: a pattern with as
many seeds as others is trusted, one with a few seeds among many others is not, as what it lends to them comes back damped. The other instances of trusted
patterns then count as seeds, and patterns are weighed anew, until no more are trusted. Instances of trusted patterns that aren't base spans are kind ``id``;
base spans always stay.

Null texts count as empty: no spans. Very long texts and words are searched whole. Spans that begin at one place are listed by kind, then
end. Repeated rows are treated row by row, whatever their ids; an empty table gives an empty result. Only the id and text columns are read by
``find_spans``; ``redact`` keeps every column and refuses names that begin with ``__pii``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Kinds in the order of the result.
KINDS = ["email", "ip", "card", "phone", "id"]
#: Java patterns for the base kinds. ``\G`` or a look-behind keeps a search from starting again
#: inside a run that has failed, possessive quantifiers from going back: all scans are linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: A seed outside the base kinds.
KEY = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"
CONFIDENCE, LEAST_SEEDS, DAMPING = 0.8, 4, 0.95
#: Scores are settled when none moves by more; rounds at most, several of them in one job; times that found instances become seeds at most.
SETTLED, ROUNDS, TOGETHER, SPREADS = 0.005, 24, 4, 5
#: Discovered spans that may be broadcast; beyond, a shuffled join is used.
SMALL = 100_000

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


#: Matches of a text that are placed in one go; it bounds copies, not results.
RUN = 64


def _accept(kind: str, token: Column) -> Column:
    if kind == "ip":
        return token.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    n = F.length(_digits(token))
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(token))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _accepting(kind: str) -> Callable[[Column], Column]:
    return lambda x: _accept(kind, x["token"])


def _as_span(kind: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def _last_words(piece: Column) -> Column:
    """The last two words of a piece, however long, lower-cased, with one blank between."""
    words = F.filter(F.split(piece, r"\s+"), lambda w: w != "")
    return F.lower(F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " "))


def _located(text: Column, pattern: str, matches: Column, context: bool = False) -> Column:
    """array<struct<start,end,token,before>> of the matches, from the pieces that they leave; before: the words left of it, if asked for."""
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    empty = F.array().cast("array<struct<start:int,end:int,token:string,before:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        one = F.struct(s.alias("start"), e.alias("end"), x["m"].alias("token"), (_last_words(x["p"]) if context else F.lit("")).alias("before"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def ends(acc: Column, run: Column) -> Column:
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def moved(run: Column, by: Column) -> Column:
        return F.transform(run["out"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["token"].alias("token"), x["before"].alias("before")))

    def placed(runs: Column) -> Column:
        before = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), ends, lambda acc: acc["out"])
        return F.flatten(F.zip_with(runs, before, moved))

    # a run of RUN matches is placed by itself and then moved, so that texts with many matches don't copy a growing array for each
    last = F.floor((F.size(matches) - 1) / RUN).cast("int")
    runs = _let(pairs, lambda p: F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(p, i * RUN + 1, F.lit(RUN)), start, step)))
    return F.when(F.size(matches) > 0, _let(runs, placed)).otherwise(empty)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _scan(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __pii_base (spans) and __pii_cand (tokens in context), one pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_digit = text.rlike("[0-9]")
    gate = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")) & has_digit}
    none = F.array().cast("array<string>")
    df = docs
    for kind, pattern in PATTERNS.items():
        df = df.withColumn(f"__pii_m_{kind}", F.when(gate.get(kind, has_digit), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("__pii_m_token", F.when(has_digit | gate["email"], F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(none))
    for kind, pattern in PATTERNS.items():
        df = df.withColumn(f"__pii_f_{kind}", F.filter(_located(text, pattern, F.col(f"__pii_m_{kind}")), _accepting(kind)))
    base = F.array_sort(F.concat(*[F.transform(f"__pii_f_{kind}", _as_span(k)) for k, kind in enumerate(PATTERNS)])).cast(_SPAN)
    df = df.withColumn("__pii_seeds", F.array_sort(F.concat(*[F.transform(f"__pii_f_{kind}", _as_seed) for kind in PATTERNS])))

    def touching(seeds: Column, start: Column, end: Column) -> Column:
        return F.filter(seeds, lambda b: (b["start"] < end) & (b["end"] > start))

    def candidate(x: Column, seeds: Column) -> Column:
        """The token's value; of a token in which a base span begins, that span; of one that a span runs on into, nothing."""
        return _let(F.get(touching(seeds, x["start"], x["end"]), F.lit(0)), lambda seed: F.when(seed.isNull(), other(x)).when(seed["start"] >= x["start"], seeded(x, seed)))

    def in_run(run: Column, seeds: Column) -> Column:
        """Candidates of RUN tokens, each held against those seeds only that touch the run."""
        near = touching(seeds, F.get(run, F.lit(0))["start"], F.element_at(run, -1)["end"])
        return _let(near, lambda few: F.transform(run, lambda x: candidate(x, few)))

    def in_runs(tokens: Column, seeds: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / RUN).cast("int"))
        return F.flatten(F.transform(at, lambda i: _let(F.slice(tokens, i * RUN + 1, F.lit(RUN)), lambda run: in_run(run, seeds))))

    def seeded(x: Column, seed: Column) -> Column:
        label = F.regexp_extract(F.substring(x["token"], F.lit(1), seed["start"] - x["start"]), r"([\p{L}_]+[:=#])[^\p{L}0-9]*$", 1)
        return F.struct(seed["start"].alias("start"), seed["end"].alias("end"), contexts(x["before"], F.lower(label)).alias("contexts"), seed["token"].alias("value"), F.lit(True).alias("base"))

    def contexts(before: Column, label: Column) -> Column:
        last = F.regexp_extract(before, r"(\S*[\p{L}\p{N}]\S*(?: [^\p{L}\p{N}\s]+)?)$", 1)
        short = F.when(label != "", F.concat(F.lit("1 "), label)).when(last.rlike("[:=#]$"), F.concat(F.lit("1 "), last))
        long = F.when(F.trim(F.concat(before, label)) != "", F.concat(F.lit("2 "), before, F.lit(" "), label))
        return F.array_distinct(F.array_compact(F.array(long, short)))

    def other(x: Column) -> Column:
        token = x["token"]
        label = F.regexp_extract(token, r"^([\p{L}_]+[:=#])", 1)
        tail = F.regexp_extract(token, r"([^0-9A-Za-z]*)$", 1)
        head = F.regexp_extract(F.substring(token, F.length(label) + 1, F.length(token)), r"^([^0-9A-Za-z@+]*)", 1)
        skip = F.length(label) + F.length(head)
        value = F.substring(token, skip + 1, F.greatest(F.length(token) - skip - F.length(tail), F.lit(0)))
        s = x["start"] + skip
        return F.struct(s.alias("start"), (s + F.length(value)).alias("end"), contexts(x["before"], F.lower(label)).alias("contexts"), value.alias("value"), F.lit(False).alias("base"))

    df = df.withColumn("__pii_tokens", _located(text, TOKEN, F.col("__pii_m_token"), context=True))
    # both arrays are bound once a row, not once a run
    every = _let(F.col("__pii_tokens"), lambda tokens: _let(F.col("__pii_seeds"), lambda seeds: F.when(F.size(tokens) > 0, in_runs(tokens, seeds))))
    cand = F.filter(F.coalesce(every, F.array()), lambda c: F.length(c["value"]) >= 3)
    out = df.withColumn("__pii_base", base).withColumn("__pii_cand", cand)
    return out.drop("__pii_seeds", "__pii_tokens", *[f"__pii_m_{k}" for k in (*PATTERNS, "token")], *[f"__pii_f_{k}" for k in PATTERNS])


def _as_seed(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"))


def _settled(edges: DataFrame) -> DataFrame:
    """(context, confidence) of a graph of (context, value, seed), when scores have settled or ROUNDS are over."""
    size = edges.groupBy("context").agg(F.count("*").alias("n"))
    weight = edges.join(size, "context").select("context", "value", "seed", "n")
    now = edges.select("context").distinct().withColumn("confidence", F.lit(0.0))
    for _ in range(ROUNDS // TOGETHER):
        before = now
        for _ in range(TOGETHER):
            score = weight.join(now, "context").groupBy("value").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(DAMPING * F.col("confidence"))).alias("score"))
            now = weight.join(score, "value").groupBy("context").agg((F.sum("score") / (F.first("n") + F.lit(0.5))).alias("confidence"))
        now = materialise(now)
        moved = now.join(before.withColumnRenamed("confidence", "was"), "context").agg(F.max(F.abs(F.col("confidence") - F.col("was"))).alias("d")).first()["d"]
        if moved is None or moved <= SETTLED:
            break
    return now


def confident_patterns(tokens: DataFrame, confidence: float = CONFIDENCE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """(context) to trust, from (context, value, seed) rows; only grouped sums and joins. Confidences rise from 0, so an early end trusts less."""
    edges = materialise(tokens.groupBy("context", "value").agg(F.max("seed").alias("seed")))
    trusted, before = edges.select("context").limit(0), 0
    for _ in range(SPREADS):
        rich = edges.where("seed").groupBy("context").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds).select("context")
        graph = materialise(edges.join(rich, "context"))
        trusted = materialise(_settled(graph).where(F.col("confidence") >= confidence).select("context"))
        if (now := trusted.count()) <= before:
            break
        before = now
        found = edges.join(trusted, "context").select("value").distinct().withColumn("found", F.lit(True))
        edges = materialise(edges.join(found, "value", "left").select("context", "value", (F.col("seed") | F.coalesce("found", F.lit(False))).alias("seed")))
    return trusted


def _extra(scanned: DataFrame) -> DataFrame:
    """(__pii_rid, __pii_extra): spans that only the learnt patterns find."""
    rows = scanned.where(F.size("__pii_cand") > 0).select("__pii_rid", F.explode("__pii_cand").alias("c")).select("__pii_rid", "c.*")
    tokens = rows.select("*", F.explode("contexts").alias("context")).drop("contexts")
    trusted = confident_patterns(tokens.select("context", "value", (F.col("base") | F.col("value").rlike(KEY)).alias("seed")))
    found = tokens.where(~F.col("base")).join(trusted, "context")
    one = F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")
    return materialise(found.groupBy("__pii_rid").agg(F.array_sort(F.collect_set(one)).cast(_SPAN).alias("__pii_extra")))


def _with_extra(scanned: DataFrame) -> DataFrame:
    """scanned with __pii_extra, which is broadcast if it holds SMALL spans at most."""
    extra = _extra(scanned)
    if (extra.agg(F.sum(F.size("__pii_extra")).alias("n")).first()["n"] or 0) <= SMALL:
        extra = F.broadcast(extra)
    return scanned.join(extra, "__pii_rid", "left")


def _all_spans() -> Column:
    return F.array_sort(F.concat("__pii_base", F.coalesce("__pii_extra", F.array().cast(_SPAN))))


def _spanned(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __pii_base and __pii_spans."""
    scanned = materialise(_scan(docs, text_col).withColumn("__pii_rid", F.monotonically_increasing_id()))
    return _with_extra(scanned).withColumn("__pii_spans", _all_spans())


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per input row."""
    narrow = docs.select(F.col(id_col).alias("__pii_id"), F.col(text_col).alias("__pii_text"))
    src = _scan(narrow, "__pii_text").drop("__pii_text")
    scanned = materialise(src.withColumn("__pii_rid", F.monotonically_increasing_id()))
    counts = [F.size(F.filter("__pii_base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return _with_extra(scanned).select(F.col("__pii_id").alias(id_col), *counts, F.sha2(_listed(F.col("__pii_base")), 256).alias("base_sha256"), _listed(_all_spans()).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; other columns stay."""
    if clash := [c for c in docs.columns if c.startswith("__pii")]:
        raise ValueError(f"reserved column names: {clash}")
    spanned = _spanned(docs, text_col)
    text, names = F.col(text_col), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        grown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, grown).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__pii_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return spanned.select(*[F.when(F.size("__pii_spans") > 0, clean).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
