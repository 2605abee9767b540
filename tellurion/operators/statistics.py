"""Statistics of groups, exact quantiles among them, and rows with their group's statistics.

Statistics are one row per group. Up to MANY groups they come to the driver once, and go back as a broadcast of checked size; so the rows
themselves are never shuffled by a survey's key, and a plan that uses statistics of statistics reads its input once. More groups than that
stay a distributed table, and the join is a plain one.

A quantile of a group of at most LEAST values, or of an input of LITTLE bytes, is taken by an aggregate that holds them. For larger groups it is found by selection: rounds of
a mergeable sketch (bounded, whatever the group's size) that propose a narrower range of values, and of exact counts below and inside it that confirm it,
until LEAST values or a single one are left. No task ever holds more of a group than that, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import islice
from math import ceil, floor, inf
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups whose statistics the driver may hold; values that one buffer may hold.
MANY, LEAST = 20_000, 1 << 16
#: Input, by the planner's estimate in bytes, that is so little that groups aren't counted first.
LITTLE = 16 << 20
#: Sketch: parts that a range is cut into, relative accuracy, ranks that are sought at once, rounds before giving up.
PARTS, ACCURACY, AT_ONCE, ROUNDS = 500, 10_000, 1_000, 60


@dataclass(frozen=True)
class Quantile:
    """The p-quantile of the values that are not null, straight between neighbours."""

    of: Column | str
    p: float

    @property
    def name(self) -> str | int:
        """The same for quantiles of one column, given by its name or as one object."""
        return self.of if isinstance(self.of, str) else id(self.of)

    @property
    def column(self) -> Column:
        return (F.col(self.of) if isinstance(self.of, str) else self.of).cast("double")


@dataclass(frozen=True)
class Sought:
    """The rank-th (from 0) of a group's ``inside`` values between low and high."""

    key: tuple[Any, ...]
    rank: int
    inside: int
    low: float = -inf
    high: float = inf
    margin: int = 2


def matched(df: DataFrame, side: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """df joined with side on by, where NULL is a key like any other; side's keys are dropped."""
    keys = [f"__k{i}" for i in range(len(by))]
    renamed = side.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], *[c for c in side.columns if c not in by])
    on = reduce(lambda a, b: a & b, [df[b].eqNullSafe(renamed[k]) for b, k in zip(by, keys, strict=True)])
    out = df.join(renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*keys)


def settled(df: DataFrame) -> DataFrame:
    """df's rows as a local table to broadcast if they are at most MANY, else df itself."""
    rows = few(df)
    return df if rows is None else F.broadcast(local(df, rows))


def few(df: DataFrame) -> list[dict[str, Any]] | None:
    """df's rows if they are at most MANY."""
    rows = df.take(MANY + 1)
    return [r.asDict() for r in rows] if len(rows) <= MANY else None


def local(like: DataFrame, rows: list[dict[str, Any]]) -> DataFrame:
    """Rows from the driver in like's columns and types."""
    return like.sparkSession.createDataFrame(pa.Table.from_pylist(rows, schema=like.limit(0).toArrow().schema), like.schema)


def _rows_of(df: DataFrame, by: Sequence[str], value: Column, sought: Sequence[Sought], extra: dict[str, list[float]]) -> DataFrame:
    """(j, v, rank, extra): values in the range of each sought rank j; sought is at most AT_ONCE rows, so it is broadcast."""
    spark, named = df.sparkSession, [f"__b{i}" for i in range(len(by))]
    types = df.select(*by).limit(0).toArrow().schema
    keys = {n: pa.array([s.key[i] for s in sought], types.field(i).type) for i, n in enumerate(named)}
    cols = {"j": range(len(sought)), "rank": [s.rank for s in sought], "low": [s.low for s in sought], "high": [s.high for s in sought], **extra}
    ranges = spark.createDataFrame(pa.table({**keys, **{c: list(x) for c, x in cols.items()}}))
    src = df.select(*[F.col(b).alias(f"__r{i}") for i, b in enumerate(by)], value.alias("v")).where("v IS NOT NULL")
    on = reduce(lambda a, b: a & b, [src[f"__r{i}"].eqNullSafe(ranges[n]) for i, n in enumerate(named)], F.lit(True))
    return src.join(F.broadcast(ranges), on & src["v"].between(ranges["low"], ranges["high"])).select("j", "v", "rank", *extra)


def _narrowed(df: DataFrame, by: Sequence[str], value: Column, sought: list[Sought]) -> list[Sought]:
    """Each range cut to the parts of a sketch round its rank, if exact counts confirm that the rank is inside."""
    cuts = [i / PARTS for i in range(PARTS + 1)]
    sketch = _rows_of(df, by, value, sought, {}).groupBy("j").agg(F.percentile_approx("v", cuts, ACCURACY).alias("s"))
    parts = {r["j"]: r["s"] for r in sketch.collect()}
    low, high = [], []
    for j, s in enumerate(sought):
        at, slack = s.rank / max(s.inside - 1, 1), s.margin / ACCURACY
        low.append(parts[j][max(0, floor((at - slack) * PARTS))])
        high.append(parts[j][min(PARTS, ceil((at + slack) * PARTS))])
    counted = _rows_of(df, by, value, sought, {"lo": low, "hi": high}).groupBy("j").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v").between(F.col("lo"), F.col("hi"))).alias("inside"))
    counts = {r["j"]: (r["below"], r["inside"]) for r in counted.collect()}
    out = []
    for j, s in enumerate(sought):
        below, inside = counts[j]
        if below <= s.rank < below + inside:
            out.append(Sought(s.key, s.rank - below, inside, low[j], high[j]))
        else:
            out.append(replace(s, margin=s.margin * 4))
    return out


def order_statistics(df: DataFrame, by: Sequence[str], value: Column, sought: Iterable[Sought]) -> Iterator[tuple[Sought, float]]:
    """The sought values, each with what it was sought as; the driver holds AT_ONCE ranges at a time."""
    left = iter(sought)
    while block := list(islice(left, AT_ONCE)):
        now = list(block)
        for _ in range(ROUNDS):
            wide = [i for i, s in enumerate(now) if s.inside > LEAST and s.low < s.high]
            if not wide:
                break
            for i, s in zip(wide, _narrowed(df, by, value, [now[i] for i in wide]), strict=True):
                now[i] = s
        else:
            raise RuntimeError("the ranges did not narrow")
        last = [i for i, s in enumerate(now) if s.low < s.high]
        found = {i: s.low for i, s in enumerate(now) if s.low == s.high}
        if last:
            rest = _rows_of(df, by, value, [now[i] for i in last], {})
            got = rest.groupBy("j").agg(F.element_at(F.array_sort(F.collect_list("v")), F.first("rank").cast("int") + 1).alias("x"))
            found |= {last[r["j"]]: r["x"] for r in got.collect()}
        yield from ((s, found[i]) for i, s in enumerate(block))


def _selected(df: DataFrame, by: Sequence[str], quantiles: dict[str, Quantile], sizes: Iterable[dict[str, Any]], column: dict[str, str]) -> list[dict[str, Any]]:
    """Rows (by, quantiles) of groups found by selection; sizes: by and the number of values of each quantile's column."""
    groups = list(sizes)
    out = [{b: g[b] for b in by} for g in groups]
    for col in dict.fromkeys(column.values()):
        mine = {n: q for n, q in quantiles.items() if column[n] == col}
        value = next(iter(mine.values())).column
        ranks = [(i, r) for i, g in enumerate(groups) if g[col] for r in sorted({f(q.p * (g[col] - 1)) for q in mine.values() for f in (floor, ceil)})]
        want = [Sought(tuple(groups[i][b] for b in by), r, groups[i][col]) for i, r in ranks]
        found = {at: x for at, (_, x) in zip(ranks, order_statistics(df, by, value, want), strict=True)}
        for i, g in enumerate(groups):
            for n, q in mine.items():
                at = q.p * (g[col] - 1)
                lo, hi = floor(at), ceil(at)
                out[i][n] = None if not g[col] else found[i, lo] if lo == hi else (hi - at) * found[i, lo] + (at - lo) * found[i, hi]
    return out


def _little(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= LITTLE


def group_stats(df: DataFrame, by: Sequence[str], **aggregates: Column | Quantile) -> DataFrame:
    """(by, aggregates), one row per group; see the module's head for where they are computed. Without by all rows are one group, and no rows none."""
    if not by:
        return group_stats(df.withColumn("__all", F.lit(0)), ["__all"], **aggregates).drop("__all")
    plain = {n: c for n, c in aggregates.items() if not isinstance(c, Quantile)}
    quantiles = {n: q for n, q in aggregates.items() if isinstance(q, Quantile)}
    if not quantiles:
        return settled(df.groupBy(*by).agg(*[c.alias(n) for n, c in plain.items()]))
    if _little(df):
        return settled(df.groupBy(*by).agg(*[(F.percentile(c.column, F.lit(float(c.p))) if isinstance(c, Quantile) else c).alias(n) for n, c in aggregates.items()]))
    known = list(dict.fromkeys(q.name for q in quantiles.values()))
    column = {n: f"__n{known.index(q.name)}" for n, q in quantiles.items()}
    counts = {column[n]: F.count(q.column).alias(column[n]) for n, q in quantiles.items()}
    sized = df.groupBy(*by).agg(*[c.alias(n) for n, c in plain.items()], *counts.values())
    first = settled(sized)
    is_large = reduce(lambda a, b: a | b, [F.col(c) > LEAST for c in counts])
    large = [r.asDict() for r in first.where(is_large).select(*by, *counts).toLocalIterator()]
    rest = df
    if large:
        rest = matched(df, settled(local(df.select(*by), [{b: g[b] for b in by} for g in large])), by, "left_anti")
    held = rest.groupBy(*by).agg(*[F.percentile(q.column, F.lit(float(q.p))).alias(n) for n, q in quantiles.items()])
    if large:
        found = _selected(df, by, quantiles, large, column)
        held = held.unionByName(local(held, found))
    held = settled(held)
    return matched(first, held, by).select(*by, *aggregates) if plain else held.select(*by, *aggregates)


def with_aggregates(df: DataFrame, by: Sequence[str], **aggregates: Column | Quantile) -> DataFrame:
    """df with statistics of its group in each row."""
    return matched(df, group_stats(df, by, **aggregates), by)


def quantiles(df: DataFrame, by: Sequence[str], col: str, probabilities: Sequence[float]) -> DataFrame:
    """(by, p, q): exact quantiles, a row for each probability."""
    got = group_stats(df, by, **{f"q{i}": Quantile(col, p) for i, p in enumerate(probabilities)})
    each = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"q{i}").alias("q")) for i, p in enumerate(probabilities)])
    return got.select(*by, F.inline(each))
