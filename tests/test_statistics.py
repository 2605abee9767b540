"""Exact quantiles by selection, and statistics that never shuffle a survey's rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurion.operators import points as P
from tellurion.operators import statistics as S
from tellurion.operators import tracks as T
from tellurion.operators.statistics import Quantile

PROBABILITIES = [0.0, 0.001, 0.05, 0.25, 0.5, 0.731, 0.95, 1.0]


def shapes():
    rng = np.random.default_rng(1)
    n = 6000
    return {
        "normal": rng.normal(size=n), "tied": rng.integers(0, 3, n).astype(float), "one": np.full(n, 7.25), "outliers": np.concatenate([rng.normal(size=n - 3), [1e300, -1e300, 1e-300]]),
        "exponents": 10.0 ** rng.uniform(-200, 200, n) * rng.choice([-1, 1], n), "half": np.where(rng.random(n) < 0.6, 0.0, rng.random(n)), "odd": rng.random(4999), "few": rng.random(9), "single": np.array([4.0]),
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(None if k == "few" else k, i % 3, float(v)) for k, vs in shapes().items() for i, v in enumerate(vs)]
    rows += [("normal", 0, None), ("nulls", 0, None), ("nulls", 1, None)]
    return spark.createDataFrame(rows, "survey_id string, track int, value double").repartition(6).cache()


@pytest.mark.parametrize("least", [4, 200, 1 << 16])
def test_quantiles_are_exact(table, monkeypatch, least):
    """However few values a buffer may hold, the result is numpy's."""
    monkeypatch.setattr(S, "LEAST", least)
    got = {(r["survey_id"], r["p"]): r["q"] for r in S.quantiles(table, ["survey_id"], "value", PROBABILITIES).collect()}
    want = {(None if k == "few" else k, p): float(np.quantile(v, p)) for k, v in shapes().items() for p in PROBABILITIES}
    assert {k: v for k, v in got.items() if k[0] != "nulls"} == {k: pytest.approx(v, rel=1e-12, abs=1e-300) for k, v in want.items()}
    assert all(got["nulls", p] is None for p in PROBABILITIES)


def test_many_groups_stay_distributed(table, monkeypatch):
    monkeypatch.setattr(S, "MANY", 2)
    monkeypatch.setattr(S, "LEAST", 50)
    monkeypatch.setattr(S, "AT_ONCE", 5)
    got = S.group_stats(table, ["survey_id", "track"], n=F.count("value"), m=Quantile("value", 0.5)).collect()
    assert len(got) == 27
    for r in got:
        v = [x for i, x in enumerate(shapes().get(r["survey_id"] or "few", [])) if i % 3 == r["track"]]
        assert r["n"] == len(v) and (r["m"] is None if not v else r["m"] == pytest.approx(np.median(v), rel=1e-12))




def test_no_group_and_no_rows(table):
    every = np.concatenate(list(shapes().values()))
    assert S.group_stats(table, [], m=Quantile("value", 0.5), n=F.count("value")).first().asDict() == {"m": pytest.approx(np.median(every)), "n": len(every)}
    assert S.group_stats(table.limit(0), [], m=Quantile("value", 0.5)).collect() == []
    assert S.with_aggregates(table.limit(0), ["survey_id"], m=Quantile("value", 0.5)).collect() == []


def test_no_buffer_holds_more_than_it_may(table, monkeypatch):
    """The aggregate that lists values sees LEAST of them at most, ties aside."""
    monkeypatch.setattr(S, "LEAST", 100)
    seen = []
    real = S._rows_of
    monkeypatch.setattr(S, "_rows_of", lambda df, by, v, sought, extra: (seen.extend(s.inside for s in sought if not extra and s.rank >= 0), real(df, by, v, sought, extra))[1])
    list(S.order_statistics(table, ["survey_id"], F.col("value"), [S.Sought(("normal",), 3000, 6000), S.Sought(("exponents",), 10, 6000)]))
    assert seen[-1] <= 100


@pytest.mark.parametrize(("reference", "config"), [("mean", "mono"), ("mean", "multi"), ("median", "multi")])
def test_level_of_large_surveys(table, monkeypatch, reference, config):
    """Levelling by selection is levelling by sorting."""
    want = T.level(table.where("survey_id = 'normal'").withColumn("pid", F.monotonically_increasing_id()), reference, config).agg(F.sum("value"), F.min("value"), F.max("value")).first()
    monkeypatch.setattr(S, "LEAST", 64)
    got = T.level(table.where("survey_id = 'normal'").withColumn("pid", F.monotonically_increasing_id()), reference, config).agg(F.sum("value"), F.min("value"), F.max("value")).first()
    assert tuple(got) == tuple(pytest.approx(x, abs=1e-9) for x in want)


STEPS = {
    "set_median": lambda p: P.set_median(p, 1.0), "set_mean": lambda p: P.set_mean(p, 1.0), "threshold": lambda p: P.threshold(p, -1.0, 1.0, "median"), "level_mean": lambda p: T.level(p, "mean", "multi"),
    "level_median": lambda p: T.level(p, "median", "multi", (5, 95)), "zero": lambda p: T.zero_tracks(p, "median", (5, 95)), "levels": lambda p: P.to_levels(p, col="value"),
    "three": lambda p: P.set_median(T.level(P.set_mean(p, 3.0), "median"), 1.0),
}


@pytest.mark.parametrize("name", sorted(STEPS))
def test_one_scan_and_no_shuffle(spark, table, tmp_path, name):
    """Rows with statistics, even statistics of statistics, are one scan and broadcasts, whatever the threshold for them."""
    table.write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        plan = STEPS[name](spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("FileScan") == 1 and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
