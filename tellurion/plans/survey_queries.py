"""Named survey queries over the survey-shaped views, each with an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.functions import geodesy
from tellurion.operators import correlation as C
from tellurion.operators import emi as M
from tellurion.operators import fits as L
from tellurion.operators import grids as G
from tellurion.operators import interpolation as I
from tellurion.operators import joins as J
from tellurion.operators import kriging as K
from tellurion.operators import points as P
from tellurion.operators import spectral as S
from tellurion.operators import statistics as Q
from tellurion.operators import tracks as T
from tellurion.shipping import ship_package
from tellurion.sources.tables import embeddings_grid, events_points, lineitem_points, orders_points

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_P = "p AS (SELECT event_id AS pid, CAST(user_id AS INT) AS track, (epoch_us(ts) - 1704067200000000) / 1000000.0 AS x, CAST(user_id AS DOUBLE) AS y, value, event_type FROM events)"
_L = "p AS (SELECT l_orderkey AS pid, CAST(l_suppkey AS INT) AS track, l_quantity AS x, round(l_discount * 100) AS y, l_extendedprice AS value FROM lineitem)"
_O = "p AS (SELECT o_orderkey AS pid, CAST(o_custkey AS INT) AS track, epoch_us(o_orderdate) / 86400000000.0 AS x, CAST(o_custkey AS DOUBLE) AS y, o_totalprice AS value FROM orders)"
_G = "g AS (SELECT CAST(vec_id AS INT) AS iy, CAST(i - 1 AS INT) AS ix, CAST(embedding[i] AS DOUBLE) AS z FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
_N = "n AS (SELECT max(ix) + 1 AS nx, max(iy) + 1 AS ny FROM g)"
# cells as targets of mirrored windows of radius 1: a clamped index is the mirror image there
_NEAR = "near AS (SELECT a.iy, a.ix, b.z AS v FROM g a, n, range(-1, 2) d(dy), range(-1, 2) e(dx), g b WHERE b.iy = least(greatest(a.iy + dy, 0), ny - 1) AND b.ix = least(greatest(a.ix + dx, 0), nx - 1))"


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def _plus(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Rounded, and without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


def _shipped(run: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    return query


def add(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = _shipped(run)
    if sql:
        SQL[name] = sql


def _ev(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(events_points(spark, d))


def _li(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(lineitem_points(spark, d))


def _or(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(orders_points(spark, d))


def _gr(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(embeddings_grid(spark, d))


def _values(df: DataFrame, *more: str) -> DataFrame:
    return _r(df.select("pid", *more, "value"), "value", *[m for m in more if m in ("x", "y", "distance")])


def _cells(df: DataFrame) -> DataFrame:
    return _r(df.select("iy", "ix", "z"), "z")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level all tracks, then the means on a lattice of two-hour by one-track cells."""
    p = T.level(events_points(spark, sf_dir))
    info = G.grid_info(p, 7200.0, 1.0)
    return G.bin_points(p, info).select("iy", "ix", F.round("z", 6).alias("z"))


# statistics ------------------------------------------------------------------

_STATS = "min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev"
add("points_stats", _li(lambda p: _r(P.stats(p).drop("survey_id"), "mean", "stdev")), f"WITH {_L} SELECT {_STATS} FROM p")
add("points_stats_by_track", _ev(lambda p: _r(P.stats(p, by=["track"]), "mean", "stdev")), f"WITH {_P} SELECT track, {_STATS} FROM p GROUP BY track")
add("grid_stats", _gr(lambda g: _r(P.stats(g, "z").drop("survey_id"), "min", "max", "mean", "stdev")), f"WITH {_G} SELECT round(min(z), 6) AS min, round(max(z), 6) AS max, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS stdev FROM g")
_Q = "round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr"
add("quartiles_iqr_by_track", _ev(lambda p: _r(P.spread(p, by=["track"], vmin=1.0, vmax=400.0), "mean", "stdev", "median", "q1", "q3", "iqr")), f"WITH {_P} SELECT track, {_Q} FROM p WHERE value BETWEEN 1 AND 400 GROUP BY track")
add("mid_interval_90", _ev(lambda p: _r(P.mid_interval(p, 90, by=["track"]), "low", "high")), f"WITH {_P} SELECT track, round(quantile_cont(value, 0.05), 6) AS low, round(quantile_cont(value, 0.95), 6) AS high FROM p GROUP BY track")
add("median_step_x", _li(lambda p: P.median_step(p, "x").drop("survey_id")), f"WITH {_L}, d AS (SELECT DISTINCT x FROM p), s AS (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM d) SELECT coalesce(round(quantile_cont(gap, 0.5), 6), 0.0) AS step FROM s")
add("median_step_y", _li(lambda p: P.median_step(p, "y").drop("survey_id")), f"WITH {_L}, d AS (SELECT DISTINCT y FROM p), s AS (SELECT y - lag(y) OVER (ORDER BY y) AS gap FROM d) SELECT coalesce(round(quantile_cont(gap, 0.5), 6), 0.0) AS step FROM s")
add("centroid", _ev(lambda p: _r(P.centroid(p, ["track"]), "x", "y")), f"WITH {_P} SELECT track, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM p GROUP BY track")
add("bounding_box", _ev(lambda p: _r(P.bounding_box(p).drop("survey_id"), "x", "y")), f"WITH {_P}, b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM p) SELECT 0 AS corner, round(x0, 6) AS x, y0 AS y FROM b UNION ALL SELECT 1, round(x1, 6), y0 FROM b UNION ALL SELECT 2, round(x0, 6), y1 FROM b UNION ALL SELECT 3, round(x1, 6), y1 FROM b")
add("histogram_50", _ev(lambda p: P.histogram(p).drop("survey_id")), f"WITH {_P}, b AS (SELECT min(value) lo, max(value) hi FROM p) SELECT CAST(least(floor((value - lo) * 50 / (hi - lo)), 49) AS INT) AS bin, count(*) AS n FROM p, b GROUP BY 1")
add("topk_min_max", _ev(lambda p: P.extremes(p, 10)), f"WITH {_P} SELECT * FROM (SELECT 'min' AS kind, pid, value FROM p ORDER BY value, pid LIMIT 10) UNION ALL SELECT * FROM (SELECT 'max' AS kind, pid, value FROM p ORDER BY value DESC, pid LIMIT 10)")
add("gaussian_moments", _ev(lambda p: _r(P.gaussian_fit(p).drop("survey_id"), "a", "x0", "sigma")), f"WITH {_P} SELECT round(count(value) * ((max(value) - min(value)) / 50) / (stddev_pop(value) * sqrt(2 * pi())), 6) AS a, round(avg(value), 6) AS x0, round(stddev_pop(value), 6) AS sigma FROM p")
add("nearest_value", _ev(lambda p: J.nearest_value(p, 50.0).drop("survey_id")), f"WITH {_P} SELECT pid, value FROM p ORDER BY abs(value - 50), pid LIMIT 1")
add("identical_tracks", _ev(lambda p: P.identical(p, ["track"])), f"WITH {_P} SELECT count(DISTINCT track) <= 1 AS identical FROM p")

# arithmetic and geometry ------------------------------------------------------

add("add_multiply_chain", _ev(lambda p: _values(P.divide(P.subtract(P.multiply(P.add(p, 10.0), 3.0), 7.0), 4.0))), f"WITH {_P} SELECT pid, round(((value + 10) * 3 - 7) / 4, 6) AS value FROM p")
add("divide_by_zero", _ev(lambda p: _values(P.divide(p, 0.0))), f"WITH {_P} SELECT pid, CAST(NULL AS DOUBLE) AS value FROM p")
add("grid_arithmetic", _gr(lambda g: _cells(P.multiply(P.add(g, 1.0, "z"), 2.5, "z"))), f"WITH {_G} SELECT iy, ix, round((z + 1) * 2.5, 6) AS z FROM g")
add("set_mean", _ev(lambda p: _values(P.set_mean(p, 5.0))), f"WITH {_P} SELECT pid, round(value + (5 - (SELECT avg(value) FROM p)), 6) AS value FROM p")
add("set_median", _ev(lambda p: _values(P.set_median(p, 5.0))), f"WITH {_P} SELECT pid, round(value + (5 - (SELECT quantile_cont(value, 0.5) FROM p)), 6) AS value FROM p")
add("set_mean_multiplicative", _ev(lambda p: _values(P.set_mean(p, 5.0, by=["track"], method="multiplicative"))), f"WITH {_P}, s AS (SELECT track, avg(value) AS m FROM p GROUP BY track) SELECT pid, round(value * 5 / nullif(m, 0), 6) AS value FROM p JOIN s USING (track)")
add("set_profile_median", _gr(lambda g: _cells(P.set_median(g, 1.0, "z", ["ix"]))), f"WITH {_G}, s AS (SELECT ix, quantile_cont(z, 0.5) AS m FROM g GROUP BY ix) SELECT iy, ix, round(z + (1 - m), 6) AS z FROM g JOIN s USING (ix)")
add("log_transform", _gr(lambda g: _cells(P.log_transform(g, 5.0, "z"))), f"WITH {_G} SELECT iy, ix, round(sign(z) * ln(1 + abs(z) * 5), 6) AS z FROM g")
add("log10_piecewise", _gr(lambda g: _cells(P.piecewise_log10(g, 50.0, "z"))), f"WITH {_G} SELECT iy, ix, round(CASE WHEN abs(z) * 50 > 1 THEN sign(z) * log10(abs(z) * 50) ELSE 0 END, 6) AS z FROM g")
add("level_quantise_256", _gr(lambda g: P.to_levels(g).select("iy", "ix", "level")), f"WITH {_G}, b AS (SELECT min(z) lo, (max(z) - min(z)) / 256 s FROM g) SELECT iy, ix, CAST(greatest(least(round_even((z - lo) / s, 0), 255), 0) AS INT) AS level FROM g, b")
add("rotate_translate", _ev(lambda p: _values(P.translate(P.rotate(p, 30.0, (100.0, 5.0)), 3.0, -2.0), "x", "y")), f"WITH {_P} SELECT pid, round(100 + (x - 100) * cos(radians(30)) - (y - 5) * sin(radians(30)) + 3, 6) AS x, round(5 + (x - 100) * sin(radians(30)) + (y - 5) * cos(radians(30)) - 2, 6) AS y, round(value, 6) AS value FROM p")
add("rotate_about_corner", _ev(lambda p: _values(P.rotate_about(p, 20.0, "BL"), "x", "y")), f"WITH {_P}, c AS (SELECT min(x) cx, min(y) cy FROM p) SELECT pid, round(cx + (x - cx) * cos(radians(-20)) - (y - cy) * sin(radians(-20)), 6) AS x, round(cy + (x - cx) * sin(radians(-20)) + (y - cy) * cos(radians(-20)), 6) AS y, round(value, 6) AS value FROM p, c")

# filters -----------------------------------------------------------------------

add("crop_box", _ev(lambda p: _values(P.crop(p, 1e5, 9e5, 3.0, 20.0), "track")), f"WITH {_P} SELECT pid, track, round(value, 6) AS value FROM p WHERE x BETWEEN 1e5 AND 9e5 AND y BETWEEN 3 AND 20")
add("get_track", _ev(lambda p: _values(P.get_track(p, [3, 5]), "track")), f"WITH {_P} SELECT pid, track, round(value, 6) AS value FROM p WHERE track IN (3, 5)")
add("threshold_clip", _ev(lambda p: _values(P.threshold(p, 10.0, 80.0))), f"WITH {_P} SELECT pid, round(CASE WHEN value < 10 THEN 10.0 WHEN value > 80 THEN 80.0 ELSE value END, 6) AS value FROM p")
for _k, _s in (("mean", "avg(value)"), ("median", "quantile_cont(value, 0.5)")):
    add(f"threshold_inlier_{_k}", _ev(lambda p, _k=_k: _values(P.threshold(p, 10.0, 80.0, _k))), f"WITH {_P}, s AS (SELECT {_s} AS m FROM p WHERE value BETWEEN 10 AND 80) SELECT pid, round(CASE WHEN value BETWEEN 10 AND 80 THEN value ELSE m END, 6) AS value FROM p, s")
add("threshold_null", _ev(lambda p: _values(P.threshold(p, 10.0, 80.0, "null"))), f"WITH {_P} SELECT pid, round(CASE WHEN value BETWEEN 10 AND 80 THEN value END, 6) AS value FROM p")
add("threshold_stats", _ev(lambda p: _r(P.threshold_stats(p, 10.0, 80.0, by=["track"]), "percent")), f"WITH {_P} SELECT track, count(*) FILTER (value NOT BETWEEN 10 AND 80) AS modified, round(100.0 * count(*) FILTER (value NOT BETWEEN 10 AND 80) / count(*), 6) AS percent FROM p GROUP BY track")
add("threshold_profile_median", _gr(lambda g: _cells(P.threshold(g, -0.2, 0.2, "median", "z", ["ix"]))), f"WITH {_G}, s AS (SELECT ix, quantile_cont(z, 0.5) AS m FROM g WHERE z BETWEEN -0.2 AND 0.2 GROUP BY ix) SELECT iy, ix, round(CASE WHEN z BETWEEN -0.2 AND 0.2 THEN z ELSE m END, 6) AS z FROM g LEFT JOIN s USING (ix)")
add("blank_rows", _ev(lambda p: _values(P.blank_rows(p, ["value"], 100, 299))), f"WITH {_P} SELECT pid, CASE WHEN pid BETWEEN 100 AND 299 THEN NULL ELSE round(value, 6) END AS value FROM p")
add("distinct_first", _ev(lambda p: P.distinct_first(p, ["track", "event_type"]).select("pid", "track", "event_type")), f"WITH {_P} SELECT min(pid) AS pid, track, event_type FROM p GROUP BY track, event_type")
add("union_fuse", _ev(lambda p: _r(P.stats(P.fuse(p, P.add(p, 1.0)), by=["track"]), "mean", "stdev")), f"WITH {_P}, u AS (SELECT track, value FROM p UNION ALL SELECT track, value + 1 FROM p) SELECT track, {_STATS} FROM u GROUP BY track")

# tracks ----------------------------------------------------------------------------

for _k, _s, _g in (("mean", "avg(value)", "stddev_pop(value)"), ("median", "quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)")):
    _with = f"WITH {_P}, t AS (SELECT track, {_s} AS s, {_g} AS g FROM p GROUP BY track), a AS (SELECT {_s} AS s, {_g} AS g FROM p)"
    add(f"level_mono_{_k}", _ev(lambda p, _k=_k: _values(T.level(p, _k))), f"{_with} SELECT pid, round(value - t.s + a.s, 6) AS value FROM p JOIN t USING (track), a")
    add(f"level_multi_{_k}", _ev(lambda p, _k=_k: _values(T.level(p, _k, "multi"))), f"{_with} SELECT pid, round((value - t.s) * CASE WHEN a.g = 0 THEN 1 ELSE a.g END / CASE WHEN t.g = 0 THEN 1 ELSE t.g END + a.s, 6) AS value FROM p JOIN t USING (track), a")
    add(f"zero_{_k}_tracks", _ev(lambda p, _k=_k: _r(T.zero_tracks(p, _k).select("pid", "value"), "value", digits=9)), f"{_with} SELECT pid, round(value - t.s, 9) AS value FROM p JOIN t USING (track)")
add("level_percentile_5_95", _ev(lambda p: _values(T.level(p, percentiles=(5, 95)))), f"WITH {_P}, q AS (SELECT quantile_cont(value, 0.05) lo, quantile_cont(value, 0.95) hi FROM p), i AS (SELECT track, value FROM p, q WHERE value BETWEEN lo AND hi), t AS (SELECT track, avg(value) AS s FROM i GROUP BY track), a AS (SELECT avg(value) AS s FROM i) SELECT pid, round(value - t.s + a.s, 6) AS value FROM p LEFT JOIN t USING (track), a")
add("level_grid_profiles", _gr(lambda g: _cells(T.level(g, col="z", by=["ix"]))), f"WITH {_G}, t AS (SELECT ix, avg(z) AS s FROM g GROUP BY ix), a AS (SELECT avg(z) AS s FROM g) SELECT iy, ix, round(z - t.s + a.s, 6) AS z FROM g JOIN t USING (ix), a")
add("destripe_neighbours_4", _gr(lambda g: _cells(T.destripe_neighbours(g, 4))), f"WITH {_G}, t AS (SELECT ix, avg(z) AS s FROM g GROUP BY ix), r AS (SELECT t.ix, avg(g.z) AS s FROM t JOIN g ON g.ix BETWEEN t.ix - 4 AND t.ix + 3 GROUP BY t.ix) SELECT iy, ix, round(z - t.s + r.s, 6) AS z FROM g JOIN t USING (ix) JOIN r USING (ix)")
add("destripe_neighbours_median", _gr(lambda g: _cells(T.destripe_neighbours(g, 2, reference="median"))), f"WITH {_G}, t AS (SELECT ix, quantile_cont(z, 0.5) AS s FROM g GROUP BY ix), r AS (SELECT t.ix, quantile_cont(g.z, 0.5) AS s FROM t JOIN g ON g.ix BETWEEN t.ix - 2 AND t.ix + 1 GROUP BY t.ix) SELECT iy, ix, round(z - t.s + r.s, 6) AS z FROM g JOIN t USING (ix) JOIN r USING (ix)")
add("detrend_linear", _or(lambda p: _r(T.detrend_linear(p).select("pid", "value"), "value", digits=4)), f"WITH {_O}, c AS (SELECT track, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, avg(value) AS m FROM p GROUP BY track) SELECT pid, round(value - coalesce(CASE WHEN isnan(a + b * x) THEN NULL ELSE a + b * x END, m), 4) AS value FROM p JOIN c USING (track)")
add("distance_along_track", _ev(lambda p: _r(T.distance_along_track(p).select("pid", "distance"), "distance")), f"WITH {_P}, d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2), 0) AS leg FROM p WINDOW w AS (PARTITION BY track ORDER BY pid)) SELECT pid, round(sum(leg) OVER (PARTITION BY track ORDER BY pid ROWS UNBOUNDED PRECEDING), 6) AS distance FROM d")
_W5 = "(PARTITION BY track ORDER BY pid ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
add("median_decision_rel", _ev(lambda p: _values(T.median_decision(p, 5, 0.8))), f"WITH {_P}, m AS (SELECT *, quantile_cont(value, 0.5) OVER {_W5} AS m FROM p) SELECT pid, round(CASE WHEN abs(value - m) > abs(0.8 * m) THEN m ELSE value END, 6) AS value FROM m")
add("median_decision_abs", _ev(lambda p: _values(T.median_decision(p, 5, 30.0, "absolute"))), f"WITH {_P}, m AS (SELECT *, quantile_cont(value, 0.5) OVER {_W5} AS m FROM p) SELECT pid, round(CASE WHEN abs(value - m) > 30 THEN m ELSE value END, 6) AS value FROM m")
add("hampel_1d_w5", _ev(lambda p: _values(T.hampel(p))), f"WITH {_P}, m AS (SELECT pid, track, value, list(value) OVER {_W5} AS l, quantile_cont(value, 0.5) OVER {_W5} AS m FROM p), d AS (SELECT pid, value, m, 1.4826 * list_aggregate(list_transform(l, lambda v: abs(v - m)), 'quantile_cont', 0.5) AS mad FROM m) SELECT pid, round(CASE WHEN mad > 0 AND abs(value - m) > 3 * mad THEN m ELSE value END, 6) AS value FROM d")
add("despike_grid_rows", _gr(lambda g: _cells(T.median_decision(g, 5, 2.0, "relative", "z", ["iy"], "ix"))), f"WITH {_G}, m AS (SELECT *, quantile_cont(z, 0.5) OVER (PARTITION BY iy ORDER BY ix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM g) SELECT iy, ix, round(CASE WHEN abs(z - m) > abs(2 * m) THEN m ELSE z END, 6) AS z FROM m")
_SEG = f"{_P}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY track ORDER BY pid) AS gap FROM p), m AS (SELECT track, quantile_cont(gap, 0.5) AS m FROM d GROUP BY track), s AS (SELECT d.*, CAST(sum(CASE WHEN gap > 3 * m THEN 1 ELSE 0 END) OVER (PARTITION BY d.track ORDER BY pid ROWS UNBOUNDED PRECEDING) + 1 AS INT) AS segment FROM d JOIN m USING (track))"


def _sessions(p: DataFrame) -> DataFrame:
    return T.gap_sessions(p.withColumn("survey_id", F.col("track").cast("string")), 3.0, "x")


add("gap_sessions", _ev(lambda p: _sessions(p).select("pid", "segment")), f"WITH {_SEG} SELECT pid, segment FROM s")
_MID = f"{_SEG}, c AS (SELECT track, segment, round(avg(x), 2) AS cx, round(avg(y), 2) AS cy FROM s GROUP BY ALL), f AS (SELECT *, sqrt((cx - first(cx) OVER w) ^ 2 + (cy - first(cy) OVER w) ^ 2) <= 50000 AND count(*) OVER (PARTITION BY track) > 1 AS b FROM c WINDOW w AS (PARTITION BY track ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), k AS (SELECT track, segment, CASE WHEN b THEN sum(b::INT) OVER w ELSE 0 END AS base, CASE WHEN b THEN 0 ELSE sum((NOT b)::INT) OVER w END AS profile FROM f WINDOW w AS (PARTITION BY track ORDER BY segment ROWS UNBOUNDED PRECEDING))"
add("base_detection", _ev(lambda p: T.detect_bases(_sessions(p), 50000.0).select("pid", "base", "profile")), f"WITH {_MID} SELECT pid, CAST(base AS INT) AS base, CAST(profile AS INT) AS profile FROM s JOIN k USING (track, segment)")
for _k, _i in (("base", 0), ("profile", 1)):
    add(f"split_{_k}s", _ev(lambda p, _i=_i: T.split_bases(T.detect_bases(_sessions(p), 50000.0))[_i].select("pid", "segment")), f"WITH {_MID} SELECT pid, segment FROM s JOIN k USING (track, segment) WHERE {_k} <> 0")
add("profile_renumber", _ev(lambda p: T.renumber(p).select("pid", "number")), f"WITH {_P}, f AS (SELECT track, min(pid) AS m FROM p GROUP BY track), r AS (SELECT track, CAST(dense_rank() OVER (ORDER BY m) AS INT) AS number FROM f) SELECT pid, number FROM p JOIN r USING (track)")
_RUNS = "SELECT pid, CAST(sum(CASE WHEN l IS NULL OR event_type = l THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY pid ROWS UNBOUNDED PRECEDING) AS INT) AS profile FROM (SELECT *, lag(event_type) OVER (PARTITION BY track ORDER BY pid) AS l FROM p)"
add("profiles_by_runs", _ev(lambda p: P.with_profiles(p.withColumn("survey_id", F.col("track").cast("string")), "event_type").select("pid", "profile")), f"WITH {_P} {_RUNS}")
add(
    "profiles_by_x", _ev(lambda p: T.profiles_by_x(p.withColumn("u", F.when(F.col("pid") % 7 != 3, F.col("pid") % 5 - 1)), "u", ["track"]).select("pid", "base", "profile", "bp", "seconds")),
    f"WITH {_P}, u AS (SELECT pid, track, CASE WHEN pid % 7 <> 3 THEN pid % 5 - 1 END AS u FROM p), f AS (SELECT *, last_value(u IGNORE NULLS) OVER (PARTITION BY track ORDER BY pid ROWS UNBOUNDED PRECEDING) AS x FROM u), l AS (SELECT *, CASE WHEN u IS NOT NULL AND lag(x) OVER (PARTITION BY track ORDER BY pid) IS DISTINCT FROM x THEN 1 ELSE 0 END AS n FROM f), c AS (SELECT *, sum(n) FILTER (x < 0) OVER w AS b, sum(n) FILTER (x >= 0) OVER w AS p FROM l WINDOW w AS (PARTITION BY track ORDER BY pid ROWS UNBOUNDED PRECEDING)) SELECT pid, CAST(CASE WHEN x < 0 THEN coalesce(b, 0) ELSE 0 END AS INT) AS base, CAST(CASE WHEN x < 0 THEN 0 ELSE coalesce(p, 0) END AS INT) AS profile, CAST(coalesce(b, 0) + coalesce(p, 0) AS INT) AS bp, -1.0::DOUBLE AS seconds FROM c",
)
add("sliding_windows", _ev(lambda p: T.sliding_windows(p, 4).select("pid", F.round(F.element_at("window", 1), 6).alias("first"), F.round(F.element_at("window", 4), 6).alias("last"), F.round(F.array_max("window"), 6).alias("top"))), f"WITH {_P}, w AS (SELECT pid, value, lead(value, 3) OVER w AS last, count(*) OVER f AS n, max(value) OVER f AS top FROM p WINDOW w AS (PARTITION BY track ORDER BY pid), f AS (PARTITION BY track ORDER BY pid ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT pid, round(value, 6) AS first, round(last, 6) AS last, round(top, 6) AS top FROM w WHERE n = 4")
_HOLES = lambda p: p.withColumn("value", F.when(F.col("pid") % 5 != 2, F.col("value")))
add(
    "fill_linear", _ev(lambda p: _values(T.fill_linear(_HOLES(p), "value", "x", ["track"]))),
    f"WITH {_P}, h AS (SELECT pid, track, x, CASE WHEN pid % 5 <> 2 THEN value END AS v FROM p), b AS (SELECT *, last_value(v IGNORE NULLS) OVER k AS v0, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER k AS x0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER f AS x1 FROM h WINDOW k AS (PARTITION BY track ORDER BY x ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY track ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT pid, round(coalesce(v, v0 + (v1 - v0) * (x - x0) / nullif(x1 - x0, 0), v0, v1), 6) AS value FROM b",
)
add(
    "regress_fill", _ev(lambda p: _r(T.regress_fill(_HOLES(p), ["value"], ["track"]).select("pid", "value"), "value", digits=4)),
    f"WITH {_P}, h AS (SELECT pid, track, CAST(row_number() OVER (PARTITION BY track ORDER BY pid) - 1 AS DOUBLE) AS i, CASE WHEN pid % 5 <> 2 THEN value END AS v FROM p), c AS (SELECT track, regr_slope(v, i) AS b, regr_intercept(v, i) AS a FROM h GROUP BY track) SELECT pid, round(coalesce(v, a + b * i), 4) AS value FROM h JOIN c USING (track)",
)
add(
    "resample_step", _ev(lambda p: _r(T.resample(p, 20000.0).select("track", "k", "value"), "value", digits=4)),
    f"WITH {_P}, g AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2), 0) AS leg FROM p WINDOW w AS (PARTITION BY track ORDER BY pid)), d AS (SELECT track, pid, value, sum(leg) OVER (PARTITION BY track ORDER BY pid ROWS UNBOUNDED PRECEDING) AS d FROM g), l AS (SELECT *, lead(d) OVER w AS d1, lead(value) OVER w AS v1 FROM d WINDOW w AS (PARTITION BY track ORDER BY d, pid)) SELECT track, CAST(k AS BIGINT) AS k, round(value + (v1 - value) * (k * 20000.0 - d) / (d1 - d), 4) AS value FROM (SELECT *, unnest(generate_series(CAST(ceil(d / 20000.0) AS BIGINT), CAST(ceil(d1 / 20000.0) AS BIGINT) - 1)) AS k FROM l WHERE d1 > d)",
)
add(
    "interpolate_segments", _ev(lambda p: T.interpolate_segments(p.withColumn("segment", F.col("track")).withColumn("x", F.bround("x", 0))).select("pid", F.round("x", 1).alias("x"))),
    f"WITH {_P}, k AS (SELECT pid, round_even(x, 0) AS x, row_number() OVER (PARTITION BY track ORDER BY pid) - 1 AS k, count(*) OVER (PARTITION BY track) AS n, first(round_even(x, 0)) OVER w AS a, last(round_even(x, 0)) OVER w AS b FROM p WINDOW w AS (PARTITION BY track ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT pid, round(round(a + CASE WHEN n > 1 THEN k / (n - 1) ELSE 0 END * (b - a), 2), 1) AS x FROM k",
)
add(
    "offset_along_track", _ev(lambda p: _r(T.offset_along_track(p, 2.0, 0.5, 9).select("pid", "x", "y"), "x", "y")),
    f"WITH {_P}, a AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY track ORDER BY pid)), u AS (SELECT *, dx / nullif(sqrt(dx * dx + dy * dy), 0) AS ux, dy / nullif(sqrt(dx * dx + dy * dy), 0) AS uy FROM a), m AS (SELECT *, (coalesce(ux, lead(ux) OVER w) + coalesce(lead(ux) OVER w, ux)) / 2 AS mx, (coalesce(uy, lead(uy) OVER w) + coalesce(lead(uy) OVER w, uy)) / 2 AS my FROM u WINDOW w AS (PARTITION BY track ORDER BY pid)) SELECT pid, round(coalesce(x + 2 * mx - 0.5 * my, x), 6) AS x, round(coalesce(y + 2 * my + 0.5 * mx, y), 6) AS y FROM m",
)
add("seconds_of_day", lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", F.date_format("ts", "HH:mm:ss").alias("t")).select("event_id", T.seconds_of_day("t").alias("seconds")), "SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS seconds FROM events")
# fits by orthogonal polynomials p1, p2, p3 of the distance in millions
_ORTHO = f"{_P}, d AS (SELECT pid, track, value AS v, sqrt((x - first(x) OVER w) ^ 2 + (y - first(y) OVER w) ^ 2) / 1e6 AS d FROM p WINDOW w AS (PARTITION BY track ORDER BY pid)), m0 AS (SELECT *, avg(d) OVER t AS a0, avg(v) OVER t AS c0 FROM d WINDOW t AS (PARTITION BY track)), q1 AS (SELECT *, d - a0 AS p1 FROM m0), m1 AS (SELECT *, sum(d * p1 * p1) OVER t / sum(p1 * p1) OVER t AS a1, sum(v * p1) OVER t / sum(p1 * p1) OVER t AS c1, avg(p1 * p1) OVER t AS b1 FROM q1 WINDOW t AS (PARTITION BY track)), q2 AS (SELECT *, (d - a1) * p1 - b1 AS p2 FROM m1), m2 AS (SELECT *, sum(d * p2 * p2) OVER t / sum(p2 * p2) OVER t AS a2, sum(v * p2) OVER t / sum(p2 * p2) OVER t AS c2, sum(p2 * p2) OVER t / sum(p1 * p1) OVER t AS b2 FROM q2 WINDOW t AS (PARTITION BY track)), q3 AS (SELECT *, (d - a2) * p2 - b2 * p1 AS p3 FROM m2), m3 AS (SELECT *, sum(v * p3) OVER t / sum(p3 * p3) OVER t AS c3 FROM q3 WINDOW t AS (PARTITION BY track))"
add("destripe_polynomial_3", _ev(lambda p: _plus(T.polynomial(p, 3).select("pid", "value"), "value", digits=3)), f"WITH {_ORTHO} SELECT pid, round(v - c0 - c1 * p1 - c2 * p2 - c3 * p3, 3) + 0.0 AS value FROM m3")
add("destripe_polynomial_mean", _ev(lambda p: _plus(T.polynomial(p, 2, "mean").select("pid", "value"), "value", digits=3)), f"WITH {_ORTHO}, k AS (SELECT avg(k0) AS k0, avg(k1) AS k1, avg(k2) AS k2 FROM (SELECT DISTINCT track, c0 - c1 * a0 + c2 * (a0 * a1 - b1) AS k0, c1 - c2 * (a0 + a1) AS k1, c2 AS k2 FROM m2)) SELECT pid, round(v - c0 - c1 * p1 - c2 * p2 + k0 + k1 * d + k2 * d * d, 3) + 0.0 AS value FROM m2, k")
add("destripe_grid_linear", _gr(lambda g: _cells(T.polynomial(g, 1, kind="grid"))), f"WITH {_G}, c AS (SELECT ix, regr_slope(z, iy) AS b, regr_intercept(z, iy) AS a FROM g GROUP BY ix) SELECT iy, ix, round(z - (a + b * iy), 6) AS z FROM g JOIN c USING (ix)")

add(
    "destripe_grid_linear_near", _gr(lambda g: _cells(T.polynomial(g, 1, 2, kind="grid"))),
    f"WITH {_G}, {_N}, c AS (SELECT ix, regr_slope(z, iy) AS b, regr_intercept(z, iy) AS a FROM g GROUP BY ix), r AS (SELECT t.ix, avg(c.a) AS ra, avg(c.b) AS rb FROM n, c t, range(-2, 3) k(d), c WHERE c.ix = least(greatest(t.ix + d, 0), nx - 1) GROUP BY t.ix) SELECT iy, ix, round(z - (a + b * iy) + ra + rb * iy, 6) AS z FROM g JOIN c USING (ix) JOIN r USING (ix)",
)

# grids ----------------------------------------------------------------------------------

add(
    "bin_grid", _li(lambda p: _r(G.bin_points(p, G.grid_info(p, 5.0, 1.0), complete=True).drop("survey_id"), "z")),
    f"WITH {_L}, i AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, CAST(round((max(x) - min(x)) / 5) AS INT) AS nx, CAST(round(max(y) - min(y)) AS INT) AS ny FROM p), b AS (SELECT CAST(least(floor((y - y0) / ((y1 - y0) / ny)), ny - 1) AS INT) AS iy, CAST(least(floor((x - x0) / ((x1 - x0) / nx)), nx - 1) AS INT) AS ix, avg(value) AS z FROM p, i GROUP BY ALL), c AS (SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix FROM i, range(ny) a(iy), range(nx) b(ix)) SELECT iy, ix, round(z, 6) AS z FROM c LEFT JOIN b USING (iy, ix)",
)
for _a, _y, _x in ((90, "nx - 1 - ix", "iy"), (180, "ny - 1 - iy", "nx - 1 - ix"), (270, "ix", "ny - 1 - iy")):
    add(f"grid_rotate{_a}", _gr(lambda g, _a=_a: _cells(G.rotate(g, _a))), f"WITH {_G}, {_N} SELECT CAST({_y} AS INT) AS iy, CAST({_x} AS INT) AS ix, round(z, 6) AS z FROM g, n")
add("grid_flip", _gr(lambda g: _cells(G.flip(G.flip(g), "vertical"))), f"WITH {_G}, {_N} SELECT CAST(ny - 1 - iy AS INT) AS iy, CAST(nx - 1 - ix AS INT) AS ix, round(z, 6) AS z FROM g, n")
add("grid_crop", _gr(lambda g: _cells(G.crop(g, 5, 40, 10, 90))), f"WITH {_G} SELECT CAST(iy - 10 AS INT) AS iy, CAST(ix - 5 AS INT) AS ix, round(z, 6) AS z FROM g WHERE ix BETWEEN 5 AND 40 AND iy BETWEEN 10 AND 90")
add("grid_shift_roll", _gr(lambda g: _cells(G.shift(g, 3, roll=True))), f"WITH {_G}, {_N} SELECT CAST((iy + 3) % ny AS INT) AS iy, ix, round(z, 6) AS z FROM g, n")
add("grid_shift_fill", _gr(lambda g: _cells(G.shift(g, 2))), f"WITH {_G} SELECT iy, ix, round(lag(z, 2) OVER (PARTITION BY ix ORDER BY iy), 6) AS z FROM g")
add("lattice_nodes", _li(lambda p: _r(G.lattice(G.grid_info(p, 7.0, 2.0)).drop("survey_id"), "x", "y")), f"WITH {_L}, i AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, CAST(round((max(x) - min(x)) / 7) AS INT) + 1 AS nx, CAST(round((max(y) - min(y)) / 2) AS INT) + 1 AS ny FROM p) SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, round(x0 + ix * (x1 - x0) / (nx - 1), 6) AS x, round(y0 + iy * (y1 - y0) / (ny - 1), 6) AS y FROM i, range(ny) a(iy), range(nx) b(ix)")
_MED = f"WITH {_G}, {_N}, {_NEAR}, m AS (SELECT iy, ix, quantile_cont(v, 0.5) AS m FROM near GROUP BY iy, ix)"
add("median2d_3x3", _gr(lambda g: _cells(G.median_filter(g, (3, 3)))), f"{_MED} SELECT iy, ix, round(m, 6) AS z FROM m")
add("median2d_3x3_decision", _gr(lambda g: _cells(G.median_filter(g, (3, 3), 0.15, "absolute"))), f"{_MED} SELECT iy, ix, round(CASE WHEN abs(z - m) > 0.15 THEN m ELSE z END, 6) AS z FROM g JOIN m USING (iy, ix)")
add(
    "hampel2d_3x3", _gr(lambda g: _cells(G.hampel_filter(g, (3, 3), 2.0))),
    f"{_MED}, d AS (SELECT iy, ix, z, m, abs(z - m) AS d FROM g JOIN m USING (iy, ix)), k AS (SELECT a.iy, a.ix, quantile_cont(b.d, 0.5) AS mad FROM d a, n, range(-1, 2) e(dy), range(-1, 2) f(dx), d b WHERE b.iy = least(greatest(a.iy + dy, 0), ny - 1) AND b.ix = least(greatest(a.ix + dx, 0), nx - 1) GROUP BY a.iy, a.ix) SELECT iy, ix, round(CASE WHEN d > 2 * 1.4826 * mad THEN m ELSE z END, 6) AS z FROM d JOIN k USING (iy, ix)",
)
_AVG = f"WITH {_G}, {_N}, {_NEAR}, m AS (SELECT iy, ix, avg(v) AS m, avg(v * v) AS q FROM near GROUP BY iy, ix)"
add("box_mean_3x3", _gr(lambda g: _cells(G.separate_trends(g, (3, 3), "regional"))), f"{_AVG} SELECT iy, ix, round(m, 6) AS z FROM m")
add("trend_local_3x3", _gr(lambda g: _cells(G.separate_trends(g, (3, 3)))), f"{_AVG} SELECT iy, ix, round(z - m, 6) AS z FROM g JOIN m USING (iy, ix)")
add("trend_local_relative", _gr(lambda g: _r(G.separate_trends(P.add(g, 5.0, "z"), (3, 3), "local", "relative").select("iy", "ix", "z"), "z")), f"{_AVG} SELECT iy, ix, round((z + 5) * ((SELECT avg(z) FROM g) + 5) / (m + 5), 6) AS z FROM g JOIN m USING (iy, ix)")
add("wallis_3x3", _gr(lambda g: _r(G.wallis(g, 3, 1.0, 2.0).select("iy", "ix", "z"), "z", digits=5)), f"{_AVG}, s AS (SELECT iy, ix, m, sqrt(greatest(q - m * m, 0)) AS s FROM m), t AS (SELECT max(s) AS top FROM s) SELECT iy, ix, round(2 / greatest(s, top * 0.1) * (z - m) + 1, 5) AS z FROM g JOIN s USING (iy, ix), t")
_LEV = f"{_G}, b AS (SELECT min(z) AS lo, max(z) AS hi FROM g), v AS (SELECT iy, ix, CAST(greatest(least(round_even((z - lo) / ((hi - lo) / 256), 0), 255), 0) AS DOUBLE) AS l FROM g, b)"
add("from_levels", _gr(lambda g: _cells(P.from_levels(P.to_levels(g), -1.0, 1.0))), f"WITH {_LEV} SELECT iy, ix, round(l * 2 / 256 - 1, 6) AS z FROM v")
add(
    "wallis_levels", _gr(lambda g: _cells(G.wallis_levels(g, 2, 2))),
    f"WITH {_LEV}, w AS (SELECT a.iy, a.ix, any_value(a.l) AS l, avg(o.l) AS m, least(stddev_pop(o.l), 25) AS s FROM v a JOIN v o ON o.iy BETWEEN a.iy - 2 AND a.iy + 2 AND o.ix BETWEEN a.ix - 2 AND a.ix + 2 GROUP BY a.iy, a.ix) SELECT iy, ix, round(lo + greatest(least((l - m) * 320 / (8 * s + 40) + 12.7 + 0.9 * m, 255), 0) * (hi - lo) / 256, 6) AS z FROM w, b",
)
add(
    "clahe", _gr(lambda g: _cells(G.clahe(g, (16, 16)))),
    f"WITH {_G}, {_N}, b AS (SELECT min(z) AS lo, max(z) AS hi FROM g), v AS (SELECT iy, ix, CAST(floor(iy / 16) AS INT) AS ty, CAST(floor(ix / 16) AS INT) AS tx, CAST(least(floor((z - lo) / (hi - lo) * 256), 255) AS INT) AS b FROM g, b), h AS (SELECT ty, tx, b, count(*) AS c, sum(count(*)) OVER (PARTITION BY ty, tx) AS n FROM v GROUP BY ty, tx, b), t AS (SELECT *, least(c, greatest(1, 0.01 * n)) AS cut FROM h), o AS (SELECT ty, tx, any_value(n) AS n, sum(c) - sum(cut) AS over FROM t GROUP BY ty, tx), k AS (SELECT o.ty, o.tx, CAST(i AS INT) AS b, (coalesce(sum(t.cut) FILTER (t.b <= i), 0) + any_value(over) * (i + 1) / 256) / any_value(o.n) AS share FROM o JOIN t USING (ty, tx), range(256) r(i) GROUP BY o.ty, o.tx, i), f AS (SELECT iy, ix, b, (iy - 7.5) / 16 AS fy, (ix - 7.5) / 16 AS fx FROM v), m AS (SELECT f.iy, f.ix, sum((CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * share) AS s FROM n, f, range(2) y(dy), range(2) x(dx), k WHERE k.b = f.b AND k.ty = greatest(least(floor(fy) + dy, floor((ny - 1) / 16)), 0) AND k.tx = greatest(least(floor(fx) + dx, floor((nx - 1) / 16)), 0) GROUP BY f.iy, f.ix) SELECT iy, ix, round(lo + s * (hi - lo), 6) AS z FROM m, b",
)
_TILE = "greatest(least(CAST(ceil((p.{c} - lo{c}) / ((hi{c} - lo{c}) / 40) - 0.5) - 1 AS INT), 39), 0)"
_TILES = f"{_P}, b AS (SELECT min(x) lox, max(x) hix, min(y) loy, max(y) hiy FROM p), t AS (SELECT {_TILE.format(c='y')} AS ty, {_TILE.format(c='x')} AS tx, count(*) AS c FROM p, b GROUP BY ALL), k AS (SELECT dy, dx, 1 - sqrt(dy * dy + dx * dx) / 3 AS w FROM range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy * dy + dx * dx <= 4), d AS (SELECT CAST(ty + dy AS INT) AS iy, CAST(tx + dx AS INT) AS ix, sum(c * w) / (4 / 3.0) AS density FROM t, k WHERE ty + dy BETWEEN 0 AND 39 AND tx + dx BETWEEN 0 AND 39 GROUP BY ALL)"
add("tile_heatmap", _ev(lambda p: _r(G.tile_density(p, 40, 2, 1.0).drop("survey_id"), "density")), f"WITH {_TILES} SELECT iy, ix, round(density, 6) AS density FROM d")
add("tile_mask", _ev(lambda p: G.tile_mask(p, 40, 2, 1.0).drop("survey_id")), f"WITH {_TILES} SELECT iy, ix FROM d WHERE round(density, 9) > 1")
add(
    "tile_mask_round", _ev(lambda p: G.tile_mask_round(p, 40, 2).drop("survey_id")),
    f"WITH {_P}, b AS (SELECT min(x) lox, max(x) hix, min(y) loy, max(y) hiy FROM p), t AS (SELECT DISTINCT {_TILE.format(c='y')} AS ty, {_TILE.format(c='x')} AS tx FROM p, b), s AS (SELECT CAST(ty - oy AS INT) AS iy, CAST(tx - ox AS INT) AS ix, oy, ox FROM t, range(-2, 3) a(oy), range(-2, 3) c(ox) WHERE oy * oy + ox * ox <= 4 AND ty - oy BETWEEN 0 AND 39 AND tx - ox BETWEEN 0 AND 39), m AS (SELECT iy, ix, sqrt(avg(oy) ^ 2 + avg(ox) ^ 2) AS off FROM s GROUP BY iy, ix), a AS (SELECT DISTINCT iy, ix, atan2(oy, ox) AS t FROM s WHERE oy <> 0 OR ox <> 0), w AS (SELECT iy, ix, coalesce(lead(t) OVER (PARTITION BY iy, ix ORDER BY t), min(t) OVER (PARTITION BY iy, ix) + 2 * pi()) - t AS gap FROM a), k AS (SELECT iy, ix FROM w GROUP BY iy, ix HAVING count(*) > 1 AND round(max(gap), 9) < round(pi(), 9)) SELECT iy, ix FROM m JOIN k USING (iy, ix) WHERE off < 1.5",
)

# correlation --------------------------------------------------------------------------------

_CORR = f"{_G}, b AS (SELECT a.ix, a.iy, a.z, l.z AS u FROM g a JOIN g l ON l.ix = a.ix - 1 AND l.iy = a.iy), s AS (SELECT ix, stddev_pop(z) * stddev_pop(u) * count(*) AS d FROM b GROUP BY ix), r AS (SELECT a.ix, a.iy - c.iy AS lag, sum(a.z * c.u) / any_value(d) AS r FROM b a JOIN b c ON a.ix = c.ix JOIN s ON s.ix = a.ix GROUP BY a.ix, a.iy - c.iy)"
add("correlation_map", _gr(lambda g: _plus(C.correlation_map(g).drop("survey_id"), "r")), f"WITH {_CORR} SELECT ix, lag, round(r, 6) + 0.0 AS r FROM r")
add("correlation_sum", _gr(lambda g: _plus(C.correlation_sum(g).drop("survey_id"), "r")), f"WITH {_CORR} SELECT lag, round(sum(r), 6) + 0.0 AS r FROM r GROUP BY lag")
add(
    "correlation_map_5_95", _gr(lambda g: _plus(C.correlation_map(g, (5, 95)).drop("survey_id"), "r")),
    f"WITH {_G}, q AS (SELECT quantile_cont(z, 0.05) AS lo, quantile_cont(z, 0.95) AS hi FROM g), h AS (SELECT g.* FROM g, q WHERE z BETWEEN lo AND hi), b AS (SELECT a.ix, a.z, l.z AS u, row_number() OVER (PARTITION BY a.ix ORDER BY a.iy) AS k FROM h a JOIN h l ON l.ix = a.ix - 1 AND l.iy = a.iy), s AS (SELECT ix, stddev_pop(z) * stddev_pop(u) * count(*) AS d FROM b GROUP BY ix) SELECT a.ix, CAST(a.k - c.k AS INT) AS lag, round(sum(a.z * c.u) / any_value(d), 6) + 0.0 AS r FROM b a JOIN b c USING (ix) JOIN s USING (ix) GROUP BY a.ix, a.k - c.k",
)
add("correlation_peak", _gr(lambda g: C.peak_lag(g).drop("survey_id")), f"WITH {_CORR}, t AS (SELECT lag, sum(r) AS r FROM r GROUP BY lag) SELECT lag FROM t ORDER BY r DESC, lag LIMIT 1")
add("profile_pearson", _gr(lambda g: _r(C.ranked_correlation(g).drop("survey_id"), "r")), f"WITH {_G} SELECT a.ix, round(corr(a.z, l.z), 6) AS r FROM g a JOIN g l ON l.ix = a.ix - 1 AND l.iy = a.iy GROUP BY a.ix")
add("profile_spearman", _gr(lambda g: _r(C.ranked_correlation(g, "spearman").drop("survey_id"), "r")), f"WITH {_G}, b AS (SELECT a.ix, a.z, l.z AS u FROM g a JOIN g l ON l.ix = a.ix - 1 AND l.iy = a.iy), r AS (SELECT ix, rank() OVER (PARTITION BY ix ORDER BY z) + (count(*) OVER (PARTITION BY ix, z) - 1) / 2 AS rz, rank() OVER (PARTITION BY ix ORDER BY u) + (count(*) OVER (PARTITION BY ix, u) - 1) / 2 AS ru FROM b) SELECT ix, round(corr(rz, ru), 6) AS r FROM r GROUP BY ix")
add("profile_kendall", _gr(lambda g: _plus(C.ranked_correlation(g, "kendall").drop("survey_id"), "r")), f"WITH {_G}, b AS (SELECT a.ix, a.z, l.z AS u FROM g a JOIN g l ON l.ix = a.ix - 1 AND l.iy = a.iy) SELECT a.ix, round(sum(sign((a.z - c.z) * (a.u - c.u))) / (count(*) - sqrt(count(*))), 6) + 0.0 AS r FROM b a JOIN b c USING (ix) GROUP BY a.ix")
add(
    "destagger_grid", _gr(lambda g: _cells(C.destagger(g, 5, 0.05))),
    f"WITH {_G}, {_N}, o AS (SELECT a.ix, a.iy, a.z, coalesce((l.z + r.z) / 2, l.z, r.z) AS m FROM g a LEFT JOIN g l ON l.ix = a.ix - 1 AND l.iy = a.iy LEFT JOIN g r ON r.ix = a.ix + 1 AND r.iy = a.iy WHERE a.ix % 2 = 1), s AS (SELECT ix, iy, (z - avg(z) OVER p) / stddev_pop(z) OVER p AS a, (m - avg(m) OVER p) / stddev_pop(m) OVER p AS b FROM o WINDOW p AS (PARTITION BY ix)), c AS (SELECT s.ix, lag, sum(t.a * s.b) / count(*) AS r FROM n, range(-5, 6) k(lag), s JOIN s t ON t.ix = s.ix WHERE t.iy = (s.iy - lag + ny) % ny GROUP BY s.ix, lag), b AS (SELECT ix, lag FROM c QUALIFY row_number() OVER (PARTITION BY ix ORDER BY r DESC, lag) = 1 AND r >= 0.05) SELECT CAST((iy + coalesce(lag, 0) + ny) % ny AS INT) AS iy, ix, round(z, 6) AS z FROM n, g LEFT JOIN b USING (ix)",
)
add("destagger_points", _ev(lambda p: _r(T.destagger_points(p.select("survey_id", "pid", "track", "x", "y", "value"), 20000.0).select("pid", "x", "y"), "x", "y", digits=3)))

# joins -------------------------------------------------------------------------------------------

_AB = f"{_P}, a AS (SELECT pid, x / 3600 AS x, y, value FROM p WHERE event_type = 'view'), b AS (SELECT pid, x / 3600 AS x, y, value FROM p WHERE event_type = 'click'), o AS (SELECT a.pid AS id_a, b.pid AS id_b, a.value AS value_a, b.value AS value_b, sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS dist FROM a JOIN b ON abs(a.x - b.x) <= 1.5 AND abs(a.y - b.y) <= 1.5 WHERE sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) <= 1.5)"


def _pair(p: DataFrame) -> DataFrame:
    p = p.withColumn("x", F.col("x") / 3600)
    return J.overlap(p.where("event_type = 'view'"), p.where("event_type = 'click'"), 1.5)


add("overlap_join_tol", _ev(lambda p: _r(_pair(p).select("id_a", "id_b", "dist"), "dist")), f"WITH {_AB} SELECT id_a, id_b, round(dist, 6) AS dist FROM o")
add("mismatch_weighted", _ev(lambda p: _r(J.mismatch(_pair(p)), "mismatch", "weight")), f"WITH {_AB}, s AS (SELECT avg(value_a - value_b) m, stddev_pop(value_a - value_b) s FROM o), k AS (SELECT value_a - value_b AS d FROM o, s WHERE abs(value_a - value_b - m) <= 2.5 * s) SELECT round(avg(d), 6) AS mismatch, round(coalesce(1 / nullif(stddev_pop(d) ^ 2, 0), 0), 6) AS weight FROM k")
add(
    "asof_base_drift", _ev(lambda p: _values(J.correct_drift(p.where("event_type <> 'signup'"), p.where("event_type = 'signup'").select("track", "x", "value"), ["track"], "x"))),
    f"WITH {_P}, b AS (SELECT track, x AS t, value AS v FROM p WHERE event_type = 'signup'), r AS (SELECT pid, track, x, value FROM p WHERE event_type <> 'signup'), k AS (SELECT r.*, (SELECT max(t) FROM b WHERE b.track = r.track AND t <= r.x) AS t0, (SELECT min(t) FROM b WHERE b.track = r.track AND t > r.x) AS t1, (SELECT arg_min(v, t) FROM b WHERE b.track = r.track) AS f FROM r), j AS (SELECT k.*, b0.v AS v0, b1.v AS v1 FROM k LEFT JOIN b b0 ON b0.track = k.track AND b0.t = t0 LEFT JOIN b b1 ON b1.track = k.track AND b1.t = t1) SELECT pid, round(coalesce(value - (coalesce(v0 + (v1 - v0) * (x - t0) / nullif(t1 - t0, 0), v0, v1) - f), value), 6) AS value FROM j",
)
add("border_pairs", _ev(lambda p: _r(J.border_pairs(p.where("event_type = 'view'").withColumn("x", F.col("x") / 3600), p.where("event_type = 'click'").withColumn("x", F.col("x") / 3600), 40, 1.5).select("id_a", "id_b", "dist"), "dist")), f"WITH {_AB}, n AS (SELECT id_a, id_b, dist, row_number() OVER (PARTITION BY id_a ORDER BY dist, id_b) AS k FROM o) SELECT id_a, id_b, round(dist, 6) AS dist FROM n WHERE k = 1 ORDER BY n.dist, id_a, id_b LIMIT 40")
add("linear_match", _ev(lambda p: _r(J.linear_match(_pair(p)), "a", "b")), f"WITH {_AB} SELECT round(avg(value_a) - stddev_pop(value_a) / stddev_pop(value_b) * avg(value_b), 6) AS a, round(stddev_pop(value_a) / stddev_pop(value_b), 6) AS b FROM o")
add("variogram_lags", _ev(lambda p: _r(I.variogram(p.withColumn("x", F.col("x") / 3600), 0.5, 4).drop("survey_id"), "distance", "gamma")), f"WITH {_P}, q AS (SELECT pid, x / 3600 AS x, y, value FROM p), d AS (SELECT sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) AS d, (a.value - b.value) ^ 2 AS s FROM q a JOIN q b ON a.pid < b.pid AND abs(a.x - b.x) < 2 AND abs(a.y - b.y) < 2) SELECT CAST(floor(d / 0.5) AS INT) AS lag, count(*) AS n, round(avg(d), 6) AS distance, round(avg(s) / 2, 6) AS gamma FROM d WHERE d > 0 AND d < 2 GROUP BY 1")
add("merge_grids", _gr(lambda g: _r(J.merge_grids([g.select("iy", "ix", "z"), G.shift(g, 1).select("iy", "ix", "z")]), "z")), f"WITH {_G}, s AS (SELECT iy, ix, lag(z) OVER (PARTITION BY ix ORDER BY iy) AS z FROM g) SELECT iy, ix, round(avg(z), 6) AS z FROM (SELECT * FROM g UNION ALL SELECT * FROM s) GROUP BY iy, ix")
add("georeference", _ev(lambda p: _r(J.georeference(p, [(-10.0, -10.0, 100.0, 200.0), (3e6, -10.0, 3100.0, 210.0), (-10.0, 5000.0, 150.0, 5200.0), (3e6, 5000.0, 3200.0, 5300.0)]).select("pid", F.col("east").isNotNull().alias("inside")), )), f"WITH {_P} SELECT pid, x BETWEEN -10 AND 3e6 AND y BETWEEN -10 AND 5000 AS inside FROM p")

_KINDS = ("view", "click", "signup")


def _kinds(p: DataFrame) -> list[DataFrame]:
    return [p.where(F.col("event_type") == k).withColumn("x", F.col("x") / 3600) for k in _KINDS]


_O3 = f"{_P}, k AS (SELECT CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS s, pid, x / 3600 AS x, y, value FROM p WHERE event_type IN ('view', 'click', 'signup'))"
add("mismatch_matrix", _ev(lambda p: _r(J.mismatch_matrix(_kinds(p), 1.5), "mismatch")), f"WITH {_O3}, o AS (SELECT a.s AS i, b.s AS j, a.value - b.value AS d FROM k a JOIN k b ON a.s < b.s AND abs(a.x - b.x) <= 1.5 AND abs(a.y - b.y) <= 1.5 WHERE sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) <= 1.5), m AS (SELECT i, j, avg(d) AS m, stddev_pop(d) AS s FROM o GROUP BY i, j), r AS (SELECT i, j, avg(d) AS d FROM o JOIN m USING (i, j) WHERE abs(d - m) <= 2.5 * s GROUP BY i, j) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(d, 6) AS mismatch FROM r UNION ALL SELECT CAST(j AS INT), CAST(i AS INT), round(-d, 6) FROM r")
for _k, _s in (("mean", "avg(value)"), ("median", "quantile_cont(value, 0.5)")):
    add(f"match_level_{_k}", _ev(lambda p, _k=_k: _values(reduce(DataFrame.unionByName, J.match_level(_kinds(p), _k)))), f"WITH {_O3}, m AS (SELECT s, {_s} AS m FROM k GROUP BY s) SELECT pid, round(value - m + (SELECT m FROM m WHERE s = 0), 6) AS value FROM k JOIN m USING (s)")

# spectra -----------------------------------------------------------------------------------------

add("wavenumbers", _gr(lambda g: _r(S.wavenumbers(g, 0.5, 2.0).select("iy", "ix", "u", "v"), "u", "v", digits=9)), f"WITH {_G}, {_N} SELECT iy, ix, round(CASE WHEN ix <= floor((nx - 1) / 2) THEN ix ELSE ix - nx END / (nx * 0.5), 9) AS u, round(CASE WHEN iy <= floor((ny - 1) / 2) THEN iy ELSE iy - ny END / (ny * 2.0), 9) AS v FROM g, n")
_TK = "CASE WHEN least({i} / ({n} - 1), 1 - {i} / ({n} - 1)) < 0.1 THEN 0.5 * (1 + cos(pi() * (2 * least({i} / ({n} - 1), 1 - {i} / ({n} - 1)) / 0.2 - 1))) ELSE 1 END"
add("apodize_tukey", _gr(lambda g: _cells(S.apodize(g, 0.1))), f"WITH {_G}, {_N} SELECT iy, ix, round(z * {_TK.format(i='ix', n='nx')} * {_TK.format(i='iy', n='ny')}, 6) AS z FROM g, n")
# sums along x, then along y
_DFT = f"{_G}, {_N}, e AS (SELECT avg(z) AS mean FROM g), c AS (SELECT iy, ix, z - mean AS z FROM g, e), fx AS (SELECT iy, CAST(kx AS INT) AS kx, sum(z * cos(2 * pi() * (kx * ix % nx) / nx)) AS re, -sum(z * sin(2 * pi() * (kx * ix % nx) / nx)) AS im FROM c, n, range(nx) b(kx) GROUP BY iy, kx), f AS (SELECT CAST(ky AS INT) AS ky, kx, sum(re * cos(2 * pi() * (ky * iy % ny) / ny) + im * sin(2 * pi() * (ky * iy % ny) / ny)) AS re, sum(im * cos(2 * pi() * (ky * iy % ny) / ny) - re * sin(2 * pi() * (ky * iy % ny) / ny)) AS im FROM fx, n, range(ny) a(ky) GROUP BY ky, kx)"
_FREQ = "q AS (SELECT *, sqrt(u * u + v * v) AS r, 2 * pi() * sqrt(u * u + v * v) AS k FROM (SELECT ky, kx, re, im, (CASE WHEN kx <= floor((nx - 1) / 2) THEN kx ELSE kx - nx END) / nx AS u, (CASE WHEN ky <= floor((ny - 1) / 2) THEN ky ELSE ky - ny END) / ny AS v FROM f, n))"


def _inverse(name: str, re: str, im: str = "0") -> str:
    """SQL of the real part of the inverse transform of the spectrum times re + i im, as a table of that name."""
    new = f"{name}w AS (SELECT ky, kx, re * ({re}) - im * ({im}) AS re, re * ({im}) + im * ({re}) AS im FROM q)"
    rows = f"{name}h AS (SELECT CAST(iy AS INT) AS iy, kx, sum(re * cos(2 * pi() * (ky * iy % ny) / ny) - im * sin(2 * pi() * (ky * iy % ny) / ny)) AS re, sum(re * sin(2 * pi() * (ky * iy % ny) / ny) + im * cos(2 * pi() * (ky * iy % ny) / ny)) AS im FROM {name}w, n, range(ny) a(iy) GROUP BY iy, kx)"
    return f"{new}, {rows}, {name} AS (SELECT iy, CAST(ix AS INT) AS ix, sum(re * cos(2 * pi() * (kx * ix % nx) / nx) - im * sin(2 * pi() * (kx * ix % nx) / nx)) / any_value(nx * ny) AS z FROM {name}h, n, range(nx) b(ix) GROUP BY iy, ix)"


def _filtered(re: str, im: str = "0", mean: bool = False, digits: int = 5) -> str:
    return f"WITH {_DFT}, {_FREQ}, {_inverse('t', re, im)} SELECT iy, ix, round(z{' + mean' if mean else ''}, {digits}) + 0.0 AS z FROM t, e"


_KEYS = ("cast(ky AS int) AS ky", "cast(kx AS int) AS kx")
_Z5 = lambda df: _plus(df.select("iy", "ix", "z"), "z", digits=5)
add("fft2_small", _gr(lambda g: _plus(S.fft2(g).selectExpr(*_KEYS, "re", "im"), "re", "im", digits=5)), f"WITH {_DFT} SELECT ky, kx, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM f")
add("spectrum_power", _gr(lambda g: _plus(S.spectrum(g, "power").selectExpr(*_KEYS, "s"), "s", digits=5)), f"WITH {_DFT} SELECT ky, kx, round((re * re + im * im) / (nx * ny), 5) AS s FROM f, n")
add("continuation_up", _gr(lambda g: _Z5(S.continue_field(g, 1.5))), _filtered("exp(-1.5 * k)", mean=True))
add("analytic_signal", _gr(lambda g: _Z5(S.analytic_signal(g))), f"WITH {_DFT}, {_FREQ}, {_inverse('dx', '0', '2 * pi() * u')}, {_inverse('dy', '0', '2 * pi() * v')}, {_inverse('dz', 'k')} SELECT iy, ix, round(sqrt(dx.z ^ 2 + dy.z ^ 2 + dz.z ^ 2), 5) AS z FROM dx JOIN dy USING (iy, ix) JOIN dz USING (iy, ix)")
_I, _D = "sin(radians(65))", "(cos(radians(65)) * cos(radians(2) - atan2(v, u)))"
add("pole_reduction", _gr(lambda g: _Z5(S.reduce_to_pole(g, 65.0, 2.0))), _filtered(f"CASE WHEN k > 0 THEN ({_I} ^ 2 - {_D} ^ 2) / ({_I} ^ 2 + {_D} ^ 2) ^ 2 ELSE 0 END", f"CASE WHEN k > 0 THEN -2 * {_I} * {_D} / ({_I} ^ 2 + {_D} ^ 2) ^ 2 ELSE 0 END"))
_M = "(cos(radians(-20)) * cos(radians(40) - atan2(v, u)))"
_RM = f"({_I} * sin(radians(-20)) - {_D} * {_M})", f"({_I} * {_M} + sin(radians(-20)) * {_D})"
add("pole_reduction_remanent", _gr(lambda g: _plus(S.reduce_to_pole(g, 65.0, 2.0, mag_inclination=-20.0, mag_declination=40.0).select("iy", "ix", "z"), "z", digits=4)), _filtered(*[f"CASE WHEN k > 0 THEN {sign}{part} / ({_RM[0]} ^ 2 + {_RM[1]} ^ 2) ELSE 0 END" for sign, part in zip(("", "-"), _RM, strict=True)], digits=4))
_C = "(cos(radians(65)) * u / r)"
add("field_to_gradient", _gr(lambda g: _Z5(S.convert_sensor(g, "TotalField", "Gradient"))), _filtered("CASE WHEN k > 0 THEN 1 - exp(-0.7 * k) ELSE 0 END"))
add("gradient_to_fluxgate", _gr(lambda g: _Z5(S.convert_sensor(g, "Gradient", "Fluxgate"))), _filtered(f"CASE WHEN k > 0 THEN {_I} / ({_I} ^ 2 + {_C} ^ 2) ELSE 0 END", f"CASE WHEN k > 0 THEN -{_C} / ({_I} ^ 2 + {_C} ^ 2) ELSE 0 END"))
add("fluxgate_to_field", _gr(lambda g: _Z5(S.convert_sensor(g, "Fluxgate", "TotalField"))), _filtered(f"CASE WHEN k > 0 THEN {_I} / (1 - exp(-0.7 * k)) ELSE 0 END", f"CASE WHEN k > 0 THEN {_C} / (1 - exp(-0.7 * k)) ELSE 0 END"))
_T = "abs((v * cos(radians(30)) - u * sin(radians(30))) / (u * cos(radians(30)) + v * sin(radians(30))))"
add("plough_filter", _gr(lambda g: _Z5(S.plough_filter(g, 30.0, 2.0, 0.3))), _filtered(f"CASE WHEN k = 0 THEN 0 WHEN {_T} <= 1 THEN exp(-((r / 0.3) ^ 2)) ELSE exp(-((r / 0.3) ^ 2)) * (1 - exp(-r * r / {_T} ^ 2)) END", mean=True))
add("euler_deconvolution", _gr(lambda g: S.euler(g, 3.0).select("iy", "ix", F.round("depth", 4).alias("depth"))))
add(
    "pad_cosine", _gr(lambda g: _cells(S.pad_cosine(g, 8))),
    f"WITH {_G}, {_N}, w AS (SELECT y, x, CASE WHEN y < 0 THEN -1 - y WHEN y >= ny THEN 2 * ny - 1 - y ELSE y END AS iy, CASE WHEN x < 0 THEN -1 - x WHEN x >= nx THEN 2 * nx - 1 - x ELSE x END AS ix, 0.25 * (1 + cos(pi() * greatest(-y, y - ny + 1, 0) / 9)) * (1 + cos(pi() * greatest(-x, x - nx + 1, 0) / 9)) AS w FROM n, range(-8, ny + 8) a(y), range(-8, nx + 8) b(x)) SELECT CAST(y + 8 AS INT) AS iy, CAST(x + 8 AS INT) AS ix, round(z * w, 6) AS z FROM w JOIN g USING (iy, ix)",
)

# interpolation and functions -----------------------------------------------------------------------

add(
    "interpolate_nearest", _li(lambda p: I.nearest(p.groupBy("survey_id", "x", "y").agg(F.max("value").alias("value")).withColumn("pid", (F.col("x") * 1000 + F.col("y")).cast("long")), G.grid_info(p, 0.5, 0.5), 1.5).select("iy", "ix", "z")),
    f"WITH {_L}, q AS (SELECT x, y, x * 1000 + y AS pid, max(value) AS value FROM p GROUP BY x, y), i AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, CAST(round((max(x) - min(x)) / 0.5) AS INT) + 1 AS nx, CAST(round((max(y) - min(y)) / 0.5) AS INT) + 1 AS ny FROM p), d AS (SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, x0 + ix * (x1 - x0) / (nx - 1) AS x, y0 + iy * (y1 - y0) / (ny - 1) AS y FROM i, range(ny) a(iy), range(nx) b(ix)), m AS (SELECT iy, ix, value, row_number() OVER (PARTITION BY iy, ix ORDER BY (q.x - d.x) ^ 2 + (q.y - d.y) ^ 2, pid) AS k FROM d JOIN q ON (q.x - d.x) ^ 2 + (q.y - d.y) ^ 2 <= 2.25) SELECT d.iy, d.ix, value AS z FROM d LEFT JOIN m ON m.iy = d.iy AND m.ix = d.ix AND k = 1",
)
_NODES = "i AS (SELECT min(x) lox, max(x) hix, min(y) loy, max(y) hiy, CAST(round((max(x) - min(x)) / 60000) AS INT) + 1 AS nx, CAST(round(max(y) - min(y)) AS INT) + 1 AS ny FROM p), o AS (SELECT iy, ix, lox + ix * (hix - lox) / (nx - 1) AS x, loy + iy * (hiy - loy) / (ny - 1) AS y FROM i, range(ny) a(iy), range(nx) b(ix))"
add(
    "masked_nodes", _ev(lambda p: I.masked(p, G.grid_info(p, 60000.0, 1.0), G.lattice(G.grid_info(p, 60000.0, 1.0)).select("survey_id", "iy", "ix", F.lit(1.0).alias("z")), 40, 2, 1.0).select("iy", "ix", "z")),
    f"WITH {_TILES}, {_NODES}, m AS (SELECT iy AS ty, ix AS tx FROM d WHERE round(density, 9) > 1 UNION SELECT ty, tx FROM t), j AS (SELECT p.iy, p.ix, {_TILE.format(c='y')} AS ty, {_TILE.format(c='x')} AS tx FROM o p, b) SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, CASE WHEN m.ty IS NOT NULL THEN 1.0::DOUBLE END AS z FROM j LEFT JOIN m USING (ty, tx)",
)
add("grid_description", _li(lambda p: G.describe(G.bin_points(p, G.grid_info(p, 7.0, 5.0)), G.grid_info(p, 7.0, 5.0)).select("nrow", "ncol", "xmin", "ymax", F.round("xsize", 6).alias("xsize"), "ysize")), f"WITH {_L}, i AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, CAST(round((max(x) - min(x)) / 7) AS INT) + 1 AS nx, CAST(round((max(y) - min(y)) / 5) AS INT) + 1 AS ny FROM p) SELECT ny AS nrow, nx AS ncol, x0 AS xmin, y1 AS ymax, round((x1 - x0) / (nx - 1), 6) AS xsize, (y1 - y0) / (ny - 1) AS ysize FROM i")
add("interpolate_linear", _li(lambda p: _r(I.linear(p.groupBy("survey_id", "x", "y").agg(F.lit(0).cast("long").alias("pid"), (2 * F.first("x") + 3 * F.first("y")).alias("value")), G.grid_info(p, 0.5, 0.5)).select("iy", "ix", "z"), "z")), f"WITH {_L}, i AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, CAST(round((max(x) - min(x)) / 0.5) AS INT) + 1 AS nx, CAST(round((max(y) - min(y)) / 0.5) AS INT) + 1 AS ny FROM p) SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, round(2 * (x0 + ix * (x1 - x0) / (nx - 1)) + 3 * (y0 + iy * (y1 - y0) / (ny - 1)), 6) AS z FROM i, range(ny) a(iy), range(nx) b(ix)")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", (F.col("c_custkey") * 7 % 160 - 80).cast("double").alias("lat"), (F.col("c_custkey") * 13 % 360 - 180).cast("double").alias("lon"))


def _utm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _places(spark, sf_dir)
    e, n, z = geodesy.utm(F.col("lat"), F.col("lon"))
    q = p.withColumns({"e": e, "n": n, "z": z})
    lat, lon = geodesy.wgs84(F.col("e"), F.col("n"), F.col("z"), F.col("lat") >= 0)
    return q.select("c_custkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon")).withColumns({"lat": F.col("lat") + 0.0, "lon": F.col("lon") + 0.0})


add("utm_roundtrip", _utm_roundtrip, "SELECT c_custkey, CAST(c_custkey * 7 % 160 - 80 AS DOUBLE) AS lat, CAST(c_custkey * 13 % 360 - 180 AS DOUBLE) AS lon FROM customer")
add(
    "utm_zone", lambda spark, d: _places(spark, d).select("c_custkey", geodesy.zone_number(F.col("lat"), F.col("lon")).alias("zone"), geodesy.zone_letter(F.col("lat")).alias("letter")),
    "WITH p AS (SELECT c_custkey, c_custkey * 7 % 160 - 80 AS lat, c_custkey * 13 % 360 - 180 AS lon FROM customer) SELECT c_custkey, CAST(CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat BETWEEN 72 AND 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE floor((lon + 180) / 6) + 1 END AS INT) AS zone, substr('CDEFGHJKLMNPQRSTUVWX', CAST(least(floor((lat + 80) / 8), 19) AS INT) + 1, 1) AS letter FROM p",
)
def _utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n, _ = geodesy.utm(F.col("lat"), F.col("lon"))
    return _places(spark, sf_dir).select("c_custkey", F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


_ZONE = "CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat BETWEEN 72 AND 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE floor((lon + 180) / 6) + 1 END"
add(
    "utm_forward", _utm,
    f"WITH p AS (SELECT c_custkey, CAST(c_custkey * 7 % 160 - 80 AS DOUBLE) AS lat, CAST(c_custkey * 13 % 360 - 180 AS DOUBLE) AS lon FROM customer), e AS (SELECT f / (2 - f) AS n, sqrt(f * (2 - f)) AS e FROM (SELECT 1 / 298.257223563 AS f)), t AS (SELECT *, asinh(tan(radians(lat))) - e * atanh(e * sin(radians(lat))) AS psi, radians(lon - ({_ZONE} * 6 - 183)) AS l FROM p, e), s AS (SELECT *, atan2(sinh(psi), cos(l)) AS xi, asinh(sin(l) / sqrt(sinh(psi) ^ 2 + cos(l) ^ 2)) AS eta, 0.9996 * 6378137 / (1 + n) * (1 + n ^ 2 / 4 + n ^ 4 / 64) AS m, [n / 2 - 2 * n ^ 2 / 3 + 5 * n ^ 3 / 16 + 41 * n ^ 4 / 180, 13 * n ^ 2 / 48 - 3 * n ^ 3 / 5 + 557 * n ^ 4 / 1440, 61 * n ^ 3 / 240 - 103 * n ^ 4 / 140, 49561 * n ^ 4 / 161280] AS a FROM t) SELECT c_custkey, round(500000 + m * (eta + a[1] * cos(2 * xi) * sinh(2 * eta) + a[2] * cos(4 * xi) * sinh(4 * eta) + a[3] * cos(6 * xi) * sinh(6 * eta) + a[4] * cos(8 * xi) * sinh(8 * eta)), 3) AS east, round(CASE WHEN lat < 0 THEN 1e7 ELSE 0 END + m * (xi + a[1] * sin(2 * xi) * cosh(2 * eta) + a[2] * sin(4 * xi) * cosh(4 * eta) + a[3] * sin(6 * xi) * cosh(6 * eta) + a[4] * sin(8 * xi) * cosh(8 * eta)), 3) AS north FROM s",
)
add("angle_format", lambda spark, d: _places(spark, d).select("c_custkey", geodesy.format_angle(F.col("lat") / 7).alias("text")), "WITH p AS (SELECT c_custkey, (c_custkey * 7 % 160 - 80) / 7 AS d FROM customer) SELECT c_custkey, CASE WHEN d < 0 THEN '-' ELSE '' END || CAST(CAST(floor(abs(d)) AS BIGINT) AS VARCHAR) || '°' || printf('%.8f', (abs(d) - floor(abs(d))) * 60) AS text FROM p")
add("angle_text", lambda spark, d: _places(spark, d).select("c_custkey", F.round(geodesy.parse_angle(geodesy.format_angle(F.col("lat") / 7)), 8).alias("lat")).withColumn("lat", F.col("lat") + 0.0), "SELECT c_custkey, round((c_custkey * 7 % 160 - 80) / 7, 8) + 0.0 AS lat FROM customer")

# electromagnetic logs: events stand for readings, the weekday for the file, the kind of event for the base -----------


def _emi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events_points(spark, sf_dir)
    base = F.when(F.col("event_type") == "signup", 1 + F.col("pid") % 3).otherwise(0).cast("int")
    return p.select(F.col("track").alias("file_id"), "pid", F.col("x").alias("seconds"), base.alias("base"), (F.col("pid") % 2 + 1).cast("int").alias("channel"), F.col("value").alias("cond"), (F.col("value") * 0.5 + F.col("pid") % 7).alias("inph"))


_E = f"{_P}, e AS (SELECT track AS file_id, pid, x AS seconds, CAST(CASE WHEN event_type = 'signup' THEN 1 + pid % 3 ELSE 0 END AS INT) AS base, CAST(pid % 2 + 1 AS INT) AS channel, value AS cond, value * 0.5 + pid % 7 AS inph FROM p)"
add(
    "synthetic_bases", lambda spark, d: _r(M.synthetic_bases(_emi(spark, d).withColumn("cond", F.round("cond", 0)), by=["base", "channel"]).select("base", "channel", "cond"), "cond", digits=1),
    f"WITH {_E}, r AS (SELECT base, channel, round(cond, 0) AS cond FROM e WHERE base <> 0), t AS (SELECT base, channel, (quantile_cont(cond, 0.05) + quantile_cont(cond, 0.95)) / 2 AS t FROM r GROUP BY ALL) SELECT base, channel, round((quantile_cont(cond, 0.5) FILTER (cond > t) + quantile_cont(cond, 0.5) FILTER (cond <= t)) / 2, 1) AS cond FROM r JOIN t USING (base, channel) GROUP BY base, channel",
)
add("channel_relation", lambda spark, d: _r(M.relation(_emi(spark, d)), "slope", "intercept"), f"WITH {_E} SELECT channel, round(regr_slope(inph, cond), 6) AS slope, round(regr_intercept(inph, cond), 6) AS intercept FROM e GROUP BY channel")


def _named(fitted: DataFrame, *names: str, digits: int = 3) -> DataFrame:
    """Coefficients as columns."""
    return fitted.select(*[c for c in fitted.columns if c != "coefficients"], *[(F.round(F.col("coefficients")[i], digits) + F.lit(0.0)).alias(c) for i, c in enumerate(names)])


add(
    "relation_inverse_cubic", lambda spark, d: _named(L.relation_fit(_emi(spark, d), "cond", "inph", ["channel"], "inverse_3"), "a", "b", "c", "d"),
    f"""WITH {_E}, k AS (SELECT channel, cond AS x, sqrt(cond) AS s, cbrt(cond) AS t, inph AS y FROM e WHERE cond >= 0 AND inph IS NOT NULL),
m AS (SELECT channel, count(*) AS n, avg(x) AS mx, avg(s) AS ms, avg(t) AS mt, avg(y) AS my FROM k GROUP BY channel),
k0 AS (SELECT channel, x - mx AS x, s - ms AS s, t - mt AS t, y - my AS y FROM k JOIN m USING (channel)),
f1 AS (SELECT channel, sum(x * s) / sum(x * x) AS xs, sum(x * t) / sum(x * x) AS xt, sum(x * y) / sum(x * x) AS xy FROM k0 GROUP BY channel),
k1 AS (SELECT channel, s - xs * x AS s, t - xt * x AS t, y - xy * x AS y FROM k0 JOIN f1 USING (channel)),
f2 AS (SELECT channel, sum(s * t) / sum(s * s) AS st, sum(s * y) / sum(s * s) AS sy FROM k1 GROUP BY channel),
f3 AS (SELECT channel, sum((t - st * s) * (y - sy * s)) / sum((t - st * s) * (t - st * s)) AS d FROM k1 JOIN f2 USING (channel) GROUP BY channel),
r AS (SELECT channel, n, mx, ms, mt, my, xs, xt, xy, sy - st * d AS c, d FROM m JOIN f1 USING (channel) JOIN f2 USING (channel) JOIN f3 USING (channel))
SELECT channel, n, round(my - (xy - xs * c - xt * d) * mx - c * ms - d * mt, 3) + 0.0 AS a, round(xy - xs * c - xt * d, 3) + 0.0 AS b, round(c, 3) + 0.0 AS c, round(d, 3) + 0.0 AS d FROM r""",
)
add("relation_robust_cubic", lambda spark, d: _named(L.relation_fit(_emi(spark, d), "cond", "inph", ["channel"], "poly_3"), "a", "b", "c", "d", digits=9))
add("gaussian_least_squares", _ev(lambda p: _r(L.gaussian_curve(p).drop("survey_id"), "a", "x0", "sigma", "squares", digits=4)))
add("calibration_cubic", lambda spark, d: M.calibrate(_emi(spark, d), [1.5, -0.2, 0.01]).select("pid", F.round("sigma", 9).alias("sigma")), f"WITH {_E}, q AS (SELECT pid, inph / 1000 AS q FROM e), s AS (SELECT pid, 1.5 * q - 0.2 * q ^ 2 + 0.01 * q ^ 3 AS s FROM q) SELECT pid, round(CASE WHEN s > 0 THEN s END, 9) AS sigma FROM s")
add("channels_wide", lambda spark, d: M.to_wide(_emi(spark, d), ["base"], [1, 2]).select("base", F.col("1_cond").isNotNull().alias("one"), F.col("2_cond").isNotNull().alias("two")), f"WITH {_E} SELECT base, count(*) FILTER (channel = 1) > 0 AS one, count(*) FILTER (channel = 2) > 0 AS two FROM e GROUP BY base")
add("emi_process", lambda spark, d: M.process(_emi(spark, d).drop("base").withColumns({"x": F.col("seconds") / 1000, "y": F.lit(0.0)}), 3.0, 50.0).select("file_id", "pid", "segment", F.round("cond", 4).alias("cond")))
add("tracks_wiped_gaps", _ev(lambda p: T.mark_gaps(p.select("survey_id", "pid", "track", "x", "value"), 1000.0).where("pid is null").groupBy("track").count().withColumnRenamed("count", "n")), f"WITH {_P}, l AS (SELECT track, lead(x) OVER (PARTITION BY track ORDER BY x) - x AS gap FROM p), m AS (SELECT track, min(gap) AS d FROM l WHERE gap > 0 GROUP BY track) SELECT track, count(*) AS n FROM l JOIN m USING (track) WHERE gap > 2000 * d GROUP BY track")
add("spread_repeats", _ev(lambda p: _r(T.spread_repeats(p.withColumn("x", F.floor(F.col("x") / 60000) * 60000.0), ["x"], ["track"]).select("pid", "x"), "x")), f"WITH {_P}, q AS (SELECT pid, track, floor(x / 60000) * 60000.0 AS x FROM p), c AS (SELECT *, sum(CASE WHEN l IS NULL OR l = x THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY pid ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT *, lag(x) OVER (PARTITION BY track ORDER BY pid) AS l FROM q)), u AS (SELECT track, r, any_value(x) AS v, count(*) AS n FROM c GROUP BY track, r), w AS (SELECT *, lead(v) OVER (PARTITION BY track ORDER BY r) AS nx FROM u) SELECT pid, round(v + coalesce((nx - v) * (row_number() OVER (PARTITION BY c.track, c.r ORDER BY pid) - 1) / n, 0), 6) AS x FROM c JOIN w ON c.track = w.track AND c.r = w.r")
add("bilinear_sample", _li(lambda p: _r(I.sample(p.select("survey_id", F.xxhash64("pid", "track", "value").alias("pid"), "x", "y", "value"), G.lattice(G.grid_info(p, 7.0, 5.0)).select("survey_id", "iy", "ix", (2 * F.col("x") - F.col("y")).alias("z")), G.grid_info(p, 7.0, 5.0)).groupBy("x", "y").agg(F.first("sampled").alias("sampled")), "sampled")), f"WITH {_L} SELECT x, y, round(2 * x - y, 6) AS sampled FROM p GROUP BY x, y")



def _halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid on a lattice of half its steps."""
    g = embeddings_grid(spark, sf_dir)
    info = g.groupBy("survey_id").agg((F.max("ix") + 1).cast("int").alias("nx"), (F.max("iy") + 1).cast("int").alias("ny"))
    info = info.withColumns({"x_min": F.lit(0.0), "x_max": F.col("nx") - 1.0, "y_min": F.lit(0.0), "y_max": F.col("ny") - 1.0})
    return I.regrid(g, info, info.withColumns({"nx": 2 * F.col("nx") - 1, "ny": 2 * F.col("ny") - 1})).select("iy", "ix", (F.round("z", 5) + F.lit(0.0)).alias("z"))


# one more node beyond each rim, then odd nodes are (-1, 9, 9, -1) / 16 of their neighbours
_HALVED = f"""WITH {_G}, {_N}, gx AS (SELECT * FROM g UNION ALL SELECT iy, CASE WHEN r = 0 THEN -1 ELSE nx END, sum(z * CASE abs(ix - CASE WHEN r = 0 THEN -1 ELSE nx END) WHEN 1 THEN 3 WHEN 2 THEN -3 ELSE 1 END) FROM g, n, range(2) e(r) WHERE abs(ix - CASE WHEN r = 0 THEN -1 ELSE nx END) <= 3 GROUP BY iy, r, nx),
hx AS (SELECT iy, 2 * ix AS ix, z FROM g UNION ALL SELECT iy, 2 * k + 1, sum(z * CASE WHEN ix IN (k, k + 1) THEN 0.5625 ELSE -0.0625 END) FROM (SELECT iy, ix, z, unnest(range(ix - 2, ix + 2)) AS k FROM gx), n WHERE k BETWEEN 0 AND nx - 2 GROUP BY iy, k),
gy AS (SELECT * FROM hx UNION ALL SELECT CASE WHEN r = 0 THEN -1 ELSE ny END, ix, sum(z * CASE abs(iy - CASE WHEN r = 0 THEN -1 ELSE ny END) WHEN 1 THEN 3 WHEN 2 THEN -3 ELSE 1 END) FROM hx, n, range(2) e(r) WHERE abs(iy - CASE WHEN r = 0 THEN -1 ELSE ny END) <= 3 GROUP BY ix, r, ny),
hy AS (SELECT 2 * iy AS iy, ix, z FROM hx UNION ALL SELECT 2 * k + 1, ix, sum(z * CASE WHEN iy IN (k, k + 1) THEN 0.5625 ELSE -0.0625 END) FROM (SELECT iy, ix, z, unnest(range(iy - 2, iy + 2)) AS k FROM gy), n WHERE k BETWEEN 0 AND ny - 2 GROUP BY ix, k)
SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, round(z, 5) + 0.0 AS z FROM hy"""  # fmt: skip
add("regrid_cubic", _halved, _HALVED)

# quantiles, rough surfaces, neighbourhoods ----------------------------------------------------------

add(
    "exact_quantiles", _li(lambda p: _r(Q.quantiles(p, ["survey_id"], "value", [0.001, 0.05, 0.5, 0.731, 0.999]).drop("survey_id"), "q")),
    f"WITH {_L}, k AS (SELECT unnest([0.001, 0.05, 0.5, 0.731, 0.999]) AS p) SELECT CAST(k.p AS DOUBLE) AS p, round((SELECT quantile_cont(value, [0.001, 0.05, 0.5, 0.731, 0.999]) FROM p)[list_position([0.001, 0.05, 0.5, 0.731, 0.999], k.p)], 6) AS q FROM k",
)
_PLACES = "d AS (SELECT x, y, avg(value) AS v FROM p GROUP BY x, y)"


def _nodes_sql(x_step: float, y_step: float) -> str:
    return f"i AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, CAST(round((max(x) - min(x)) / {x_step}) AS INT) + 1 AS nx, CAST(round((max(y) - min(y)) / {y_step}) AS INT) + 1 AS ny FROM p), o AS (SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, x0 + ix * (x1 - x0) / (nx - 1) AS qx, y0 + iy * (y1 - y0) / (ny - 1) AS qy FROM i, range(ny) a(iy), range(nx) b(ix))"


# on the lattice of quantities and discounts the triangles' legs are sure, their diagonals aren't: nodes on points and on legs
add(
    "interpolate_linear_rough", _li(lambda p: _r(I.linear(p, G.grid_info(p, 0.5, 0.5)).where("iy % 2 = 0 OR ix % 2 = 0").select("iy", "ix", "z"), "z", digits=4)),
    f"WITH {_L}, {_PLACES}, {_nodes_sql(0.5, 0.5)} SELECT iy, ix, round(avg(v), 4) AS z FROM o JOIN d ON abs(d.x - qx) <= 0.5 AND abs(d.y - qy) <= 0.5 WHERE (iy % 2 = 0 OR ix % 2 = 0) GROUP BY iy, ix",
)
add("interpolate_cubic", _li(lambda p: _r(I.cubic(p, G.grid_info(p, 0.5, 0.5)).select("iy", "ix", "z"), "z", digits=4)))
_LOCAL = {"kind": "spherical", "nugget": 0.0, "sill": 1.0, "range": 9.0}


def _krige_near(p: DataFrame) -> DataFrame:
    shape, far = I.MODELS["spherical"], _LOCAL["range"]
    return K.krige_near(p, G.grid_info(p, 3.3, 0.7), lambda h: shape(h, far), 12)


add(
    "nearest_twelve", _li(lambda p: _r(_krige_near(p).select("iy", "ix", "farthest", "used"), "farthest")),
    f"WITH {_L}, {_PLACES}, {_nodes_sql(3.3, 0.7)}, r AS (SELECT iy, ix, sqrt((x - qx) ^ 2 + (y - qy) ^ 2) AS f, row_number() OVER (PARTITION BY iy, ix ORDER BY (x - qx) ^ 2 + (y - qy) ^ 2) AS k FROM o, d) SELECT iy, ix, round(max(f), 6) AS farthest, CAST(count(*) AS INT) AS used FROM r WHERE k <= 12 GROUP BY iy, ix",
)
add("krige_local", _li(lambda p: _r(_krige_near(p).select("iy", "ix", "z", "stdev"), "z", "stdev", digits=4)))
