"""Every survey query against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

from tellurion.plans import survey_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _key(row):
    return tuple((v is None, str(v) if not isinstance(v, float) else f"{v:.3e}") for v in row)


def _rows(rows, cols):
    order = [cols.index(c) for c in sorted(cols)]
    return sorted((tuple(r[i] for i in order) for r in rows), key=_key)


@pytest.mark.parametrize("name", sorted(survey_queries.SQL))
def test_against_sql(spark, sf_dir, con, name):
    df = survey_queries.QUERIES[name](spark, sf_dir)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    rel = con.sql(survey_queries.SQL[name])
    want = _rows(rel.fetchall(), list(rel.columns))
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    ints = {i for i, c in enumerate(sorted(df.columns)) if dict(df.dtypes)[c] not in ("double",)}
    by = sorted(ints)
    if by:
        got.sort(key=lambda r: _key(tuple(r[i] for i in by) + tuple(r)))
        want.sort(key=lambda r: _key(tuple(r[i] for i in by) + tuple(r)))
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, (int, float)):
                assert math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5), (a, b)
            else:
                assert x == y or str(x) == str(y), (a, b)


@pytest.mark.parametrize("name", sorted(set(survey_queries.QUERIES) - set(survey_queries.SQL)))
def test_without_sql_runs(spark, sf_dir, name):
    df = survey_queries.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(("name", "col", "top"), [("euler_deconvolution", "iy", 6), ("correlation_map", "lag", 1), ("correlation_sum", "lag", 1), ("fft2_small", "ky", 1), ("spectrum_power", "ky", 1), ("continuation_up", "iy", 1)])
def test_whole_table(spark, sf_dir, con, name, col, top):
    """Not only the first rows of embeddings: the largest index is that of the last row, less a margin."""
    last = con.sql("SELECT max(vec_id) + 1 FROM embeddings").fetchall()[0][0]
    assert survey_queries.QUERIES[name](spark, sf_dir).agg({col: "max"}).first()[0] >= last - top > 63


@pytest.mark.parametrize("name", ["level_mono_mean", "level_multi_median", "wallis_3x3", "grid_flip", "bin_grid", "tile_heatmap", "median2d_3x3", "analytic_signal", "set_mean", "threshold_inlier_mean", "mismatch_weighted", "mismatch_matrix", "match_level_median", "level_multi_median"])
def test_joins_on_surveys_are_no_products(spark, sf_dir, name):
    plan = survey_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_whole_columns(spark, sf_dir, con):
    """Correlations of two whole neighbouring columns in numpy."""
    import numpy as np

    z = np.array([r[0] for r in con.sql("SELECT embedding FROM embeddings ORDER BY vec_id").fetchall()], float)
    n = len(z)
    k = survey_queries.QUERIES["profile_kendall"](spark, sf_dir).where("ix = 3").first()["r"]
    u, v = z[:, 2], z[:, 3]
    assert math.isclose(k, np.sign(np.subtract.outer(v, v) * np.subtract.outer(u, u)).sum() / (n * (n - 1)), abs_tol=2e-3)
    totals = sum(np.correlate(z[:, i], z[:, i - 1], "full") / (n * z[:, i].std() * z[:, i - 1].std()) for i in range(1, z.shape[1]))
    assert survey_queries.QUERIES["correlation_peak"](spark, sf_dir).first()["lag"] == int(np.argmax(totals)) - (n - 1)
