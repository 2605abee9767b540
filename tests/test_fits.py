from statistics import NormalDist

import numpy as np
import pytest

from tellurion.operators import emi as M
from tellurion.operators import fits as L
from tellurion.operators import statistics as Q


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(2)
    x = rng.uniform(0.1, 9, 900)
    y = 1 + x - 0.5 * x**2 + 0.2 * x**3 + rng.normal(0, 0.05, 900)
    y[::9] += rng.uniform(20, 60, 100)  # outliers on one side
    return x, y


def frame(spark, x, y, group=0):
    return spark.createDataFrame([(group, float(a), float(b)) for a, b in zip(x, y, strict=True)], "g int, x double, y double")


def test_robust_cubic_equals_plain_version(spark, cloud):
    x, y = cloud
    got = L.relation_fit(frame(spark, x, y), "x", "y", ["g"], "poly_3").first()
    assert got["n"] == 900 and np.allclose(got["coefficients"], M.fit_relation(x, y, "poly_3"), rtol=1e-4, atol=1e-4)
    assert np.allclose(got["coefficients"], [1, 1, -0.5, 0.2], atol=0.1)
    plain = L.relation_fit(frame(spark, x, y), "x", "y", ["g"], "poly_3", robust=False).first()["coefficients"]
    assert np.allclose(plain, np.polyfit(x, y, 3)[::-1], rtol=1e-6)


def test_large_groups_and_many_groups(spark, cloud, monkeypatch):
    """The same with medians by selection, and with coefficients that stay a table."""
    x, y = cloud
    want = M.fit_relation(x, y, "poly_3")
    monkeypatch.setattr(Q, "LITTLE", 0)
    monkeypatch.setattr(Q, "LEAST", 200)
    got = L.relation_fit(frame(spark, x, y), "x", "y", ["g"], "poly_3", rounds=4).first()["coefficients"]
    assert np.allclose(got, want, rtol=0.05, atol=0.05)
    monkeypatch.setattr(Q, "MANY", 0)
    again = L.relation_fit(frame(spark, x, y), "x", "y", ["g"], "poly_3", rounds=4).first()["coefficients"]
    assert np.allclose(got, again, rtol=1e-9)


def test_inverse_cubic_recovers_coefficients(spark):
    x = np.linspace(0, 40, 300)
    df = frame(spark, x, 3 + 0.25 * x - 2 * np.sqrt(x) + 1.5 * np.cbrt(x)).unionAll(spark.createDataFrame([(0, -4.0, 9.0), (0, None, 1.0), (0, 1.0, None), (0, float("nan"), 1.0), (0, 2.0, float("inf"))], "g int, x double, y double"))
    got = L.relation_fit(df, "x", "y", kind="inverse_3").first()
    assert got["n"] == 300 and np.allclose(got["coefficients"], [3, 0.25, -2, 1.5], atol=1e-5)


def test_groups_that_settle_nothing(spark):
    df = frame(spark, [1, 2, 3], [2, 4, 6]).unionAll(frame(spark, [5, 5], [1, 2], 1)).unionAll(frame(spark, [1, 2, 3, 4], [1, 2, 3, 4], None))
    got = {r["g"]: r["coefficients"] for r in L.relation_fit(df, "x", "y", ["g"], robust=True).collect()}
    assert np.allclose(got[0], [0, 2], atol=1e-9) and got[1] is None and np.allclose(got[None], [0, 1], atol=1e-9)
    assert L.relation_fit(df.limit(0), "x", "y", ["g"]).count() == 0
    with pytest.raises(ValueError):
        L.relation_fit(df, "x", "y", ["g"], "other")


def test_gaussian_curve(spark):
    """A planted normal curve over even noise: nearer than its moments, and no small step betters it."""
    normal = [NormalDist(10, 2).inv_cdf((i + 0.5) / 4000) for i in range(4000)]
    even = np.linspace(-30, 50, 400).tolist()
    df = spark.createDataFrame([("a", v) for v in normal + even] + [("b", 1.0), ("b", 1.0), ("c", None)], "survey_id string, value double")
    got = {r["survey_id"]: r for r in L.gaussian_curve(df, 80).collect()}
    a = got["a"]
    assert abs(a["x0"] - 10) < 0.02 and abs(a["sigma"] - 2) < 0.1 and got["b"]["a"] is None and "c" not in got
    count, edge = np.histogram(normal + even, 80)
    at = (edge[1:] + edge[:-1]) / 2

    def squares(p):
        return ((count - p[0] * np.exp(-((at - p[1]) ** 2) / (2 * p[2] ** 2))) ** 2).sum()

    best = np.array([a["a"], a["x0"], a["sigma"]])
    assert np.isclose(squares(best), a["squares"])
    for i in range(3):
        for by in (1 - 1e-3, 1 + 1e-3):
            p = best.copy()
            p[i] *= by
            assert squares(p) > a["squares"]
