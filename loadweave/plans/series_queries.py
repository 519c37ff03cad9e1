"""Time axis, integrity, relations, features and calibration on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import calibration as cal
from ..operators import features, integrity, metrics, relations, resample
from ..streaming import feedback
from . import inputs as i
from .registry import SQL, query, rounded

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


@query(f"""SELECT event_type AS series_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(avg(value), 6) AS value
  FROM events GROUP BY 1, 2""")
def hourly_resample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.hourly_mean(i.events(spark, d)).withColumn("ts", i.stamp("ts")))


@query(f"WITH {i.LOAD} SELECT series_id, {TS}, round(value, 6) AS value FROM load")
def hourly_spine(spark: SparkSession, d: str) -> DataFrame:
    return rounded(i.load(spark, d).withColumn("ts", i.stamp("ts")))


@query("""WITH h AS (SELECT DISTINCT event_type AS series_id, date_trunc('hour', ts) AS ts FROM events),
full_days AS (SELECT series_id, CAST(ts AS DATE) AS d FROM h GROUP BY 1, 2 HAVING count(*) = 24)
SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY d) - 1 AS INT) AS day_idx, CAST(d AS VARCHAR) AS local_date
  FROM full_days""")
def complete_days(spark: SparkSession, d: str) -> DataFrame:
    x = resample.daily_matrix(resample.hourly_mean(i.events(spark, d)))
    return x.select("series_id", "day_idx", F.col("local_date").cast("string").alias("local_date")).distinct()


@query("""WITH h AS (SELECT DISTINCT event_type AS series_id, date_trunc('hour', ts) AS ts FROM events),
x AS (SELECT series_id, ts, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS b FROM h)
SELECT series_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS gap_start, strftime(ts, '%Y-%m-%d %H:%M:%S') AS gap_end,
  CAST(date_diff('second', b, ts) // 3600 - 1 AS BIGINT) AS missing_slots FROM x WHERE date_diff('second', b, ts) > 3600""")
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    g = integrity.gaps(resample.hourly_mean(i.events(spark, d)))
    return g.withColumns({c: i.stamp(c) for c in ("gap_start", "gap_end")})


@query("""WITH h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, count(*) AS k FROM events GROUP BY 1, 2),
b AS (SELECT series_id, sum(k) AS n, sum(k) - count(*) AS n_duplicates FROM h GROUP BY 1),
x AS (SELECT series_id, date_diff('second', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) // 3600 AS s FROM h),
g AS (SELECT series_id, count(*) FILTER (s > 1) AS n_gaps, coalesce(sum(s - 1) FILTER (s > 1), 0) AS missing_slots FROM x GROUP BY 1),
dd AS (SELECT series_id, CAST(ts AS DATE) AS d, count(*) AS k FROM h GROUP BY 1, 2),
o AS (SELECT series_id, count(*) FILTER (k <> 24 AND d <> lo AND d <> hi) AS n_odd_days FROM
  (SELECT *, min(d) OVER (PARTITION BY series_id) AS lo, max(d) OVER (PARTITION BY series_id) AS hi FROM dd) GROUP BY 1)
SELECT b.series_id, CAST(n AS BIGINT) AS n, CAST(n_duplicates AS BIGINT) AS n_duplicates, 0::BIGINT AS n_not_finite, n_gaps,
  CAST(missing_slots AS BIGINT) AS missing_slots, n_odd_days
FROM b JOIN g USING (series_id) JOIN o USING (series_id)""")
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    return integrity.integrity_report(i.events(spark, d).withColumn("ts", F.date_trunc("hour", "ts")))


@query("""SELECT event_id, event_type AS series_id, round(value, 6) AS value FROM
(SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    e = i.events(spark, d).withColumn("hour_ts", F.date_trunc("hour", "ts"))
    return rounded(relations.keep_first(e, ["series_id", "hour_ts"], ["ts", "event_id"]).select("event_id", "series_id", "value"))


MODELS = """m AS (SELECT series_id, 'persist' AS model, persist AS pred, value AS actual, day_idx FROM based UNION ALL SELECT series_id, 'snaive',
  snaive, value, day_idx FROM based),
last AS (SELECT series_id, max(day_idx) AS hi FROM days GROUP BY 1),
sel AS (SELECT m.* FROM m JOIN last USING (series_id) WHERE day_idx > hi - 7 AND pred IS NOT NULL),
agg AS (SELECT series_id, model, count(*) AS n, avg(abs(pred - actual)) AS mae, sqrt(avg((pred - actual) * (pred - actual))) AS rmse,
  100 * avg(abs(pred - actual) / nullif(abs(actual), 0)) AS mape, avg(pred - actual) AS bias FROM sel GROUP BY 1, 2)"""


def _last_week(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    x = i.based(spark, d).withColumn("hi", F.max("day_idx").over(W.partitionBy("series_id")))
    return x.where("day_idx > hi - 7").withColumn("actual", F.col("value"))


@query(f"""WITH {i.BASED}, {MODELS} SELECT series_id, model, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape,
  round(bias, 6) AS bias,
round((1 - mae / nullif(max(CASE WHEN model = 'snaive' THEN mae END) OVER (PARTITION BY series_id), 0)) * 100, 6) + 0.0 AS skill FROM agg""")
def persistence_snaive_mae(spark: SparkSession, d: str) -> DataFrame:
    x = _last_week(spark, d).select("series_id", "actual", "persist", "snaive")
    return rounded(metrics.model_table(x, ["series_id"], ["persist", "snaive"]))


@query(f"""WITH {i.BASED}, {MODELS}, step AS (SELECT series_id, day_idx, abs(value - persist) AS s FROM based),
sc AS (SELECT series_id, avg(s) AS scale FROM step JOIN last USING (series_id) WHERE day_idx >= 8 AND day_idx < hi + 1 - 7 GROUP BY 1)
SELECT series_id, model, n, round(mae, 6) AS mae, round(mae / nullif(scale, 0), 6) AS mase FROM agg JOIN sc USING (series_id)""")
def mase_by_model(spark: SparkSession, d: str) -> DataFrame:
    x = _last_week(spark, d).select("series_id", "actual", "persist", "snaive")
    scale = metrics.day_lag_scale(i.days(spark, d), 8, 7)
    return rounded(metrics.model_table(x, ["series_id"], ["persist", "snaive"], scale=scale).select("series_id", "model", "n", "mae", "mase"))


@query(f"""WITH {i.BASED}, w AS (SELECT series_id, day_idx, hour, value, local_date,
  lag(value, 7) OVER q AS v1, lag(value, 14) OVER q AS v2, lag(value, 21) OVER q AS v3, lag(value, 28) OVER q AS v4,
  lag(local_date, 7) OVER q AS d1, lag(local_date, 14) OVER q AS d2, lag(local_date, 21) OVER q AS d3, lag(local_date, 28) OVER q AS d4
  FROM days WINDOW q AS (PARTITION BY series_id, hour ORDER BY day_idx)),
hol AS (SELECT DATE '2024-01-10' AS d UNION ALL SELECT DATE '2024-01-17' UNION ALL SELECT DATE '2024-01-01')
SELECT series_id, day_idx, hour, round(coalesce(CASE WHEN d1 NOT IN (SELECT d FROM hol) THEN v1 END, CASE WHEN d2 NOT IN (SELECT d FROM hol)
  THEN v2 END,
  CASE WHEN d3 NOT IN (SELECT d FROM hol) THEN v3 END, CASE WHEN d4 NOT IN (SELECT d FROM hol) THEN v4 END, v4, v3, v2, v1), 6) AS base FROM w
  WHERE v1 IS NOT NULL""")
def holiday_base(spark: SparkSession, d: str) -> DataFrame:
    hol = spark.sql("select explode(array(date'2024-01-10', date'2024-01-17', date'2024-01-01')) as holiday")
    x = features.holiday_aware_base(i.days(spark, d), hol, weeks=4).where("base is not null")
    return rounded(x.select("series_id", "day_idx", "hour", "base"))


@query(f"""WITH {i.DAYS}, m AS (SELECT *, avg(value) OVER (PARTITION BY series_id, day_idx) AS dm FROM days),
l AS (SELECT series_id, day_idx, hour, local_date, value, lag(value, 1) OVER q AS l1, lag(value, 7) OVER q AS l7, lag(value, 8) OVER q AS l8,
  lag(value, 14) OVER q AS l14, lag(local_date, 7) OVER q AS d7,
  lag(dm, 1) OVER q AS m1, lag(dm, 8) OVER q AS m8 FROM m WINDOW q AS (PARTITION BY series_id, hour ORDER BY day_idx)),
b AS (SELECT *, CASE WHEN d7 = DATE '2024-01-15' AND l14 IS NOT NULL THEN l14 ELSE l7 END AS base FROM l)
SELECT series_id, day_idx, hour, round(l1 - l8, 6) AS dev_prev, round(m1 - m8, 6) AS dev_mean, round(m1 - m8, 6) AS trend,
  round(l1 - l7, 6) AS week_step,
  round(sin(2 * pi() * hour / 24), 6) + 0.0 AS sin_h1, round(cos(2 * pi() * hour / 24), 6) + 0.0 AS cos_h1,
  round(sin(4 * pi() * hour / 24), 6) + 0.0 AS sin_h2, round(cos(4 * pi() * hour / 24), 6) + 0.0 AS cos_h2,
  round(sin(2 * pi() * (isodow(local_date) - 1) / 7), 6) + 0.0 AS sin_d1, round(cos(2 * pi() * (isodow(local_date) - 1) / 7), 6) + 0.0 AS cos_d1,
  CASE WHEN isodow(local_date) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS weekend, CASE WHEN local_date = DATE '2024-01-15' THEN 1.0
  ELSE 0.0 END::DOUBLE AS holiday, round(base, 6) AS base, round(value - base, 6) AS target FROM b WHERE day_idx >= 8""")
def features13(spark: SparkSession, d: str) -> DataFrame:
    hol = spark.sql("select date'2024-01-15' as holiday")
    x = features.features(i.days(spark, d), hol)
    return rounded(x.select("series_id", "day_idx", "hour", *[c for c in features.FEATURES if c != "one"], "base", "target"))


@query(f"""WITH {i.DAYS}, m AS (SELECT *, avg(value) OVER (PARTITION BY series_id, day_idx) AS dm FROM days),
l AS (SELECT series_id, day_idx, hour, local_date, value, lag(value, 2) OVER q - lag(value, 9) OVER q AS d_2_9,
  lag(value, 3) OVER q - lag(value, 10) OVER q AS d_3_10,
  lag(value, 7) OVER q - lag(value, 14) OVER q AS d_7_14, avg(value) OVER (q ROWS BETWEEN 3 PRECEDING
  AND 1 PRECEDING) - lag(value, 7) OVER q AS roll3,
  avg(value) OVER (q ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) - lag(value, 7) OVER q AS roll7, lag(dm, 1) OVER q - lag(dm, 8) OVER q AS dd
  FROM m WINDOW q AS (PARTITION BY series_id, hour ORDER BY day_idx)),
e AS (SELECT *, exp(-pow(hour - 19.0, 2) / 8) AS eve, exp(-pow(hour - 8.0, 2) / 8) AS morn, CASE WHEN isodow(local_date) >= 6 THEN 1.0
  ELSE 0.0 END::DOUBLE AS we FROM l)
SELECT series_id, day_idx, hour, round(d_2_9, 6) AS d_2_9, round(d_3_10, 6) AS d_3_10, round(d_7_14, 6) AS d_7_14, round(roll3, 6) AS roll3,
  round(roll7, 6) AS roll7,
  round(eve * dd, 6) + 0.0 AS evening_dev, round(morn * dd, 6) + 0.0 AS morning_dev, round(we * eve, 6) + 0.0 AS weekend_evening,
  round(we * morn, 6) + 0.0 AS weekend_morning FROM e WHERE day_idx >= 14""")
def small_load_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.small_load_features(i.days(spark, d)).select("series_id", "day_idx", "hour", *features.SMALL))


@query(f"""WITH {i.BASED} SELECT series_id, hour, count(*) AS n, round(quantile_cont(value - snaive, 0.1), 6) AS q10,
  round(quantile_cont(value - snaive, 0.9), 6) AS q90
FROM based WHERE snaive IS NOT NULL GROUP BY 1, 2""")
def residual_quantiles_by_hour(spark: SparkSession, d: str) -> DataFrame:
    x = i.based(spark, d).withColumn("residual", F.col("target"))
    return rounded(metrics.residual_quantiles(x, ["series_id", "hour"]))


@query(f"""WITH {i.BANDS}, p AS (SELECT series_id, count(*) AS n, avg(greatest(0.1 * (actual - p10), -0.9 * (actual - p10))) AS a,
  avg(greatest(0.5 * (actual - p50), -0.5 * (actual - p50))) AS b,
  avg(greatest(0.9 * (actual - p90), -0.1 * (actual - p90))) AS c, 100 * avg(CASE WHEN actual BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END) AS cov,
  avg(p90 - p10) AS w FROM bands GROUP BY 1)
SELECT series_id, n, round(a, 6) AS pinball_p10, round(b, 6) AS pinball_p50, round(c, 6) AS pinball_p90, round(cov, 6) AS coverage,
  round(w, 6) AS width, round((a + b + c) / 3, 6) AS crps_proxy FROM p""")
def pinball_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.probabilistic_metrics(i.bands(spark, d), ["series_id"], {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


@query(f"WITH {i.BASED} SELECT series_id, day_idx, round(avg(abs(snaive - value)), 6) AS mae FROM based WHERE snaive IS NOT NULL GROUP BY 1, 2")
def daily_mae(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.daily_mae(i.based(spark, d), ["series_id"], "snaive", "value"))


@query(f"""WITH {i.LOAD}, md AS (SELECT series_id, median(value) AS med FROM load GROUP BY 1), sg AS (SELECT series_id, any_value(med) AS med,
  median(abs(value - med)) * 1.4826 AS sigma FROM load JOIN md USING (series_id) GROUP BY 1)
SELECT series_id, {TS}, round(value, 6) AS value FROM load JOIN sg USING (series_id) WHERE sigma > 1e-12 AND abs(value - med) > 3 * sigma""")
def outlier_mad(spark: SparkSession, d: str) -> DataFrame:
    x = integrity.point_checks(i.load(spark, d), mad_k=3.0).where(F.array_contains("issues", "outlier"))
    return rounded(x.select("series_id", i.stamp("ts").alias("ts"), "value"))


@query(f"""WITH {i.LOAD}, v AS (SELECT series_id, ts, CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END AS value FROM load),
c AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS ch FROM v WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM c)
SELECT series_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS run_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS run_end, count(*) AS length,
  CAST(any_value(value) AS DOUBLE) AS value
FROM g GROUP BY series_id, id HAVING count(*) >= 6""")
def frozen_runs(spark: SparkSession, d: str) -> DataFrame:
    x = i.load(spark, d).withColumn("value", F.when(F.col("value") > 0, 1.0).otherwise(0.0))
    return integrity.frozen_runs(x).withColumns({c: i.stamp(c) for c in ("run_start", "run_end")})


_OK = "CASE WHEN value > 50 THEN value END"


@query(f"""WITH {i.LOAD}, x AS (SELECT series_id, ts, value, {_OK} AS ok, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS i FROM load),
y AS (SELECT *, coalesce(lag(ok, 24) OVER w, lead(ok, 24) OVER w, lag(ok, 48) OVER w, lead(ok, 48) OVER w, lag(ok, 72) OVER w,
  lead(ok, 72) OVER w) AS seasonal,
  last_value(ok IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv, last_value(CASE WHEN ok IS NOT NULL
  THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi,
  first_value(ok IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS qv, first_value(CASE WHEN ok IS NOT NULL
  THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS qi,
  quantile_cont(ok, 0.5) OVER (w ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING) AS near FROM x WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
z AS (SELECT *, CASE WHEN qi - pi - 1 <= 2 THEN pv + (qv - pv) * (i - pi) / (qi - pi) END AS line FROM y)
SELECT series_id, {TS}, round(CASE WHEN ok IS NOT NULL THEN value ELSE coalesce(seasonal, line, near) END, 3) AS filled,
  CASE WHEN ok IS NOT NULL THEN 'kept' WHEN seasonal IS NOT NULL THEN 'seasonal' WHEN line IS NOT NULL THEN 'line' WHEN near IS NOT NULL
  THEN 'median' ELSE 'unreplaceable' END AS method FROM z""")
def impute_cascade(spark: SparkSession, d: str) -> DataFrame:
    x = integrity.impute(i.load(spark, d).withColumn("good", F.col("value") > 50))
    return rounded(x.select("series_id", i.stamp("ts").alias("ts"), "filled", "method"), "filled", digits=3)


@query(f"""WITH {i.LOAD}, e AS (SELECT event_type AS series_id, ts, max(value) AS value FROM events GROUP BY 1, 2)
SELECT l.series_id, strftime(l.ts, '%Y-%m-%d %H:%M:%S') AS ts, round(e.value, 6) AS asof_value FROM load l ASOF LEFT JOIN e
  ON l.series_id = e.series_id AND l.ts >= e.ts""")
def ffill_asof(spark: SparkSession, d: str) -> DataFrame:
    e = i.events(spark, d).groupBy("series_id", "ts").agg(F.max("value").alias("value"))
    x = resample.as_of(i.load(spark, d).select("series_id", "ts"), e)
    return rounded(x.withColumn("ts", i.stamp("ts")))


@query("""SELECT o_orderpriority AS series_id, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, month(o_orderdate)::INT AS m,
CASE WHEN grouping(month(o_orderdate)) = 0 THEN 0 WHEN grouping(quarter(o_orderdate)) = 0 THEN 1 ELSE 2 END AS level,
  round(sum(o_totalprice), 2) AS value FROM orders
GROUP BY GROUPING SETS ((o_orderpriority, year(o_orderdate), quarter(o_orderdate), month(o_orderdate)), (o_orderpriority, year(o_orderdate),
  quarter(o_orderdate)), (o_orderpriority, year(o_orderdate)))""")
def grouping_sets_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    o = i.table(spark, d, "orders")
    x = o.select(
        F.col("o_orderpriority").alias("series_id"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"),
        F.month("o_orderdate").alias("m"), F.col("o_totalprice").alias("value")
    )
    return rounded(resample.temporal_levels(x, [["y", "q", "m"], ["y", "q"], ["y"]]), "value", digits=2)


@query(f"""WITH {i.LOAD}, p AS (SELECT a.series_id AS a, b.series_id AS b, count(*) AS overlap, corr(a.value, b.value) AS r FROM load a
  JOIN load b ON a.ts = b.ts AND a.series_id < b.series_id GROUP BY 1, 2)
SELECT a, b, overlap, round(r, 6) AS r FROM p WHERE overlap >= 100""")
def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.pair_correlations(i.load(spark, d), 100), "r", digits=6)


@query("""WITH o AS (SELECT o_custkey % 60 AS s, date_trunc('month', o_orderdate) AS ts, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
g AS (SELECT s, ts FROM (SELECT DISTINCT s FROM o) CROSS JOIN (SELECT DISTINCT ts FROM o) WHERE NOT (s % 20 = 7 AND month(ts) = 1)),
x AS (SELECT 's' || s AS series_id, g.ts, coalesce(v, 0.0) AS v FROM g LEFT JOIN o USING (s, ts))
SELECT a.series_id AS a, b.series_id AS b, count(*) AS overlap, round(corr(a.v, b.v), 6) AS r FROM x a JOIN x b ON a.ts = b.ts AND a.series_id < b.series_id
GROUP BY ALL HAVING corr(a.v, b.v) >= 0.25""")
def corr_above(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of order series by month that correlate, found without comparing all pairs; some series lack a month a year."""
    o = i.table(spark, d, "orders").select((F.col("o_custkey") % 60).alias("s"), F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("ts"), "o_totalprice")
    o = o.groupBy("s", "ts").agg(F.sum("o_totalprice").alias("v"))
    months = F.broadcast(o.select("ts").distinct())  # one row a month
    grid = o.select("s").distinct().crossJoin(months).where("not (s % 20 = 7 and month(ts) = 1)")
    x = grid.join(o, ["s", "ts"], "left").select(F.concat(F.lit("s"), "s").alias("series_id"), "ts", F.coalesce("v", F.lit(0.0)).alias("value"))
    return rounded(relations.correlated_pairs(x, 0.25, 24), "r")


@query(f"""WITH RECURSIVE {i.LOAD}, p AS (SELECT a.series_id AS a, b.series_id AS b, corr(a.value, b.value) AS r FROM load a JOIN load b
  ON a.ts = b.ts AND a.series_id < b.series_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE r >= 0.0 UNION SELECT b, a FROM p WHERE r >= 0.0), n AS (SELECT DISTINCT series_id AS id FROM load),
reach AS (SELECT id, id AS other FROM n UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a)
SELECT id, min(other) AS component FROM reach GROUP BY 1""")
def corr_clusters(spark: SparkSession, d: str) -> DataFrame:
    x = i.load(spark, d)
    edges = relations.pair_correlations(x, 100).where("r >= 0.0").select("a", "b")
    return relations.clusters(x.select(F.col("series_id").alias("id")).distinct(), edges)


@query("""WITH s AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS series_id, epoch(o_orderdate)::BIGINT AS t, o_totalprice AS v FROM orders),
d AS (SELECT series_id, t, max(v) AS v FROM s GROUP BY 1, 2), two AS (SELECT * FROM d UNION ALL SELECT 'copy-' || series_id, t, v FROM d
  WHERE series_id < '3'),
h AS (SELECT series_id, sha256(string_agg(t || ':' || printf('%.6f', round(v, 6)), ',' ORDER BY t)) AS content_hash FROM two GROUP BY 1)
SELECT series_id, content_hash, min(series_id) OVER (PARTITION BY content_hash) AS canonical FROM h""")
def hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = i.table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).cast("string").alias("series_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("v")
    )
    s = s.groupBy("series_id", "ts").agg(F.max("v").alias("value"))
    two = s.unionByName(s.where("series_id < '3'").withColumn("series_id", F.concat(F.lit("copy-"), "series_id")))
    return relations.exact_duplicates(relations.series_hash(two))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    done = i.table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return relations.still_to_do(i.table(spark, d, "supplier").select("s_suppkey"), done, ["s_suppkey"])


@query("""SELECT s_nationkey, s_suppkey, turn FROM (SELECT s_nationkey, s_suppkey,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS turn FROM supplier)
WHERE turn <= 3 ORDER BY turn, s_nationkey LIMIT 40""")
def round_robin_pick(spark: SparkSession, d: str) -> DataFrame:
    return relations.round_robin(i.table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", 40, 3)


@query("""WITH base AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS h FROM orders WHERE o_totalprice > 400000),
  add_ AS (SELECT DATE '1997-12-24' AS h), rem AS (SELECT min(h) AS h FROM base)
SELECT CAST(h AS VARCHAR) AS holiday FROM (SELECT h FROM base UNION SELECT h FROM add_ EXCEPT SELECT h FROM rem)""")
def holiday_overrides(spark: SparkSession, d: str) -> DataFrame:
    base = i.table(spark, d, "orders").where("o_totalprice > 400000").select(F.to_date("o_orderdate").alias("holiday")).distinct()
    out = relations.override_holidays(base, spark.sql("select date'1997-12-24' as holiday"), base.agg(F.min("holiday").alias("holiday")))
    return out.select(F.col("holiday").cast("string").alias("holiday"))


@query("""WITH t AS (SELECT o_orderkey, replace(replace(replace(printf('%,.2f', o_totalprice), ',', '#'), '.', ','), '#', '.') AS txt FROM orders)
SELECT o_orderkey, CAST(replace(replace(txt, '.', ''), ',', '.') AS DOUBLE) AS value FROM t""")
def german_numbers(spark: SparkSession, d: str) -> DataFrame:
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    x = i.table(spark, d, "orders").select("o_orderkey", text.alias("txt"))
    return fc.parse_numbers(x, "txt", "value").select("o_orderkey", "value")


@query("""SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events""")
def parse_stamps(spark: SparkSession, d: str) -> DataFrame:
    x = i.events(spark, d).select("event_id", F.concat(F.date_format("ts", "dd.MM.yyyy HH:mm"), F.lit(" Mi")).alias("txt"))
    return fc.parse_timestamps(x, "txt", "ts").select("event_id", i.stamp("ts").alias("ts"))


@query("""SELECT l_returnflag AS unit, round(sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 1e-6 WHEN 'N' THEN 1e-3 ELSE 1.0 END), 6) AS mw
  FROM lineitem GROUP BY 1""")
def unit_normalisation(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("l_returnflag") == "A", " w").when(F.col("l_returnflag") == "N", "kW").otherwise("MW")
    x = i.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity") * fc.unit_factor(unit)).alias("mw"))
    return rounded(x.withColumnRenamed("l_returnflag", "unit"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity / 2.0 AS s, l_extendedprice / 100.0 AS ghi, l_discount * 400 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(0, ghi / 1000) * greatest(0.75, least(1.1, 1 - 0.003 * (t - 25))), 6) AS pv,
round(CASE WHEN s <= 3 THEN 0 WHEN s < 5 THEN (s - 3) / 2 * 0.10 WHEN s < 8 THEN 0.10 + (s - 5) / 3 * 0.35 WHEN s < 12
  THEN 0.45 + (s - 8) / 4 * 0.55 WHEN s < 25 THEN 1 WHEN s < 26 THEN 26 - s ELSE 0 END, 6)::DOUBLE AS wind FROM p""")
def generation_proxies(spark: SparkSession, d: str) -> DataFrame:
    x = i.table(spark, d, "lineitem")
    return rounded(x.select("l_orderkey", "l_linenumber", fc.pv_proxy(F.col("l_extendedprice") / 100, F.col("l_discount") * 400).alias("pv"), fc.wind_proxy(F.col("l_quantity") / 2.0).alias("wind")))


@query(f"""WITH {i.LOAD}, w AS (SELECT ts, max(CASE WHEN series_id = 'click' THEN value END) AS c, max(CASE WHEN series_id = 'view'
  THEN value END) AS v, max(CASE WHEN series_id = 'purchase' THEN value END) AS p FROM load GROUP BY 1)
SELECT {TS}, round(v - (c + p + p), 6) AS value FROM w WHERE v IS NOT NULL AND c IS NOT NULL AND p IS NOT NULL""")
def residual_load(spark: SparkSession, d: str) -> DataFrame:
    x = i.load(spark, d)
    part = lambda n: x.where(F.col("series_id") == n).withColumn("series_id", F.lit("all"))
    out = resample.residual_load(part("view"), part("click"), part("purchase"), part("purchase"))
    return rounded(out.select(i.stamp("ts").alias("ts"), "value"))


@query(f"""WITH {i.LOAD}, c AS (SELECT ts, series_id,
  round(sum(value) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 2) - CASE WHEN hour(ts) = 5 THEN 1000 ELSE 0 END AS v
  FROM load),
f AS (SELECT ts, round(v - lag(v) OVER (PARTITION BY series_id ORDER BY ts), 2) AS d FROM c), s AS (SELECT ts, sum(d) FILTER (d >= 0) AS v,
  count(*) FILTER (d >= 0) AS k FROM f GROUP BY 1)
SELECT {TS}, round(v * 4 * 2.0 / 1000, 6) AS value FROM s WHERE k >= 4""")
def cumulative_counters(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    from ..sources.counters import grid_import

    total = F.sum("value").over(W.partitionBy("series_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    x = i.load(spark, d).withColumn("value", F.round(total, 2) - F.when(F.hour("ts") == 5, 1000).otherwise(0))
    return rounded(grid_import(x, 2.0, 4).select(i.stamp("ts").alias("ts"), "value"))


# --- calibration --------------------------------------------------------------------------------
GRID = "g AS (SELECT 0.3 + 2.7 * k / 135.0 AS s FROM range(136) t(k))"
HIST = """hist AS (SELECT f.series_id, f.day AS for_day, b.* EXCLUDE (series_id) FROM (SELECT DISTINCT series_id, day FROM bands) f JOIN bands b
  ON b.series_id = f.series_id AND b.day >= f.day - 7 AND b.day < f.day),
enough AS (SELECT series_id, for_day FROM hist GROUP BY 1, 2 HAVING count(DISTINCT day) >= 3)"""


@query(f"""WITH {i.BANDS}, {HIST}, {GRID}, h AS (SELECT series_id, for_day, s, avg(CASE WHEN actual BETWEEN p50 - s * (p50 - p10)
  AND p50 + s * (p90 - p50) THEN 1.0 ELSE 0.0 END) AS c
  FROM hist JOIN enough USING (series_id, for_day), g GROUP BY 1, 2, 3),
b AS (SELECT series_id, for_day, arg_min(s, (round(abs(c - 0.8), 12), s)) AS s FROM h GROUP BY 1, 2)
SELECT f.series_id, f.day, round(coalesce(1 + 0.5 * (b.s - 1), 1.0), 6) AS scale FROM (SELECT DISTINCT series_id, day FROM bands) f LEFT JOIN b
  ON f.series_id = b.series_id AND f.day = b.for_day""")
def rolling_band_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.rolling_scale(i.bands(spark, d), window=7, least=3))


@query(f"""WITH {i.BANDS}, {HIST}, {GRID}, h AS (SELECT series_id, for_day, s, avg(CASE WHEN actual < p50 - s * (p50 - p10) THEN 1.0
  ELSE 0.0 END) AS lo, avg(CASE WHEN actual > p50 + s * (p90 - p50) THEN 1.0 ELSE 0.0 END) AS hi
  FROM hist JOIN enough USING (series_id, for_day), g GROUP BY 1, 2, 3),
b AS (SELECT series_id, for_day, arg_min(s, (round(abs(lo - 0.1), 12), s)) AS l, arg_min(s, (round(abs(hi - 0.1), 12), s)) AS u FROM h GROUP BY 1, 2)
SELECT f.series_id, f.day, round(coalesce(1 + 0.5 * (b.l - 1), 1.0), 6) AS scale_low, round(coalesce(1 + 0.5 * (b.u - 1), 1.0), 6) AS scale_high
  FROM (SELECT DISTINCT series_id, day FROM bands) f LEFT JOIN b ON f.series_id = b.series_id AND f.day = b.for_day""")
def rolling_tail_scales(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.rolling_tail_scales(i.bands(spark, d), window=7, least=3))


@query(f"""WITH {i.BANDS}, r AS (SELECT series_id, day, hour, p50, actual - p50 AS e, lag(actual - p50) OVER (PARTITION BY series_id,
  hour ORDER BY day) AS b FROM bands),
hist AS (SELECT f.series_id, f.day AS for_day, r.day, r.e, r.b FROM (SELECT DISTINCT series_id, day FROM r) f JOIN r ON r.series_id = f.series_id
  AND r.day >= f.day - 7 AND r.day < f.day),
enough AS (SELECT series_id, for_day FROM hist GROUP BY 1, 2 HAVING count(DISTINCT day) >= 3), g AS (SELECT 0.8 * k / 16.0 AS r FROM range(17) t(k)),
m AS (SELECT series_id, for_day, g.r, avg(abs(e - g.r * b)) AS mae FROM hist JOIN enough USING (series_id, for_day), g WHERE b IS NOT NULL
  GROUP BY 1, 2, 3),
best AS (SELECT series_id, for_day, arg_min(r, (round(mae, 9), r)) AS rho FROM m GROUP BY 1, 2)
SELECT r.series_id, r.day, r.hour, round(0.5 * coalesce(rho, 0), 6) + 0.0 AS rho, round(coalesce(0.5 * coalesce(rho, 0) * b, 0), 6) + 0.0 AS delta,
  round(p50 + coalesce(0.5 * coalesce(rho, 0) * b, 0), 6) AS corrected
FROM r LEFT JOIN best ON r.series_id = best.series_id AND r.day = best.for_day""")
def residual_feedback(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.residual_feedback(i.bands(spark, d), window=7, least=3))


@query(SQL["residual_feedback"])
def live_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream of the rows: each day's shift as it was known when the day before was over."""
    root = f"{relations._scratch(spark)}/feedback-{uuid.uuid4().hex}"
    rows = i.bands(spark, d).select("series_id", "day", "hour", "p50", "actual")
    rows.write.parquet(f"{root}/rows")
    found = feedback.daily_feedback(spark.readStream.schema(rows.schema).parquet(f"{root}/rows"), window=7, least=3, late="0 hours")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, feedback.ROCKS)
    try:
        out = found.writeStream.format("parquet").option("checkpointLocation", f"{root}/mark").outputMode("append").trigger(availableNow=True)
        out.start(f"{root}/shifts").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    shifts = spark.read.schema(feedback.OUT).parquet(f"{root}/shifts")
    x = spark.read.schema(rows.schema).parquet(f"{root}/rows").join(shifts.groupBy("series_id", "day").agg(F.max("rho").alias("rho")), ["series_id", "day"], "left")
    x = x.join(shifts.drop("rho"), ["series_id", "day", "hour"], "left").na.fill(0.0, ["rho"])
    delta = F.coalesce(F.col("rho") * F.col("residual"), F.lit(0.0))
    return rounded(x.select("series_id", "day", "hour", "rho", delta.alias("delta"), (F.col("p50") + delta).alias("corrected")))


@query(f"""WITH {i.BANDS}, s AS (SELECT series_id, day, 0.5 * sum(pow(0.5, (11 - hour) / 3.0) * (actual - p50)) / sum(pow(0.5,
  (11 - hour) / 3.0)) AS shift FROM bands WHERE hour < 12 GROUP BY 1, 2)
SELECT series_id, day, hour, round(shift, 6) AS shift, round(p10 + shift, 6) AS p10, round(p50 + shift, 6) AS p50, round(p90 + shift, 6) AS p90
  FROM bands JOIN s USING (series_id, day) WHERE hour >= 12""")
def intraday_update(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.intraday(i.bands(spark, d), 12).select("series_id", "day", "hour", "shift", "p10", "p50", "p90"))


@query(f"""WITH {i.BANDS}, s AS (SELECT series_id, greatest(p10 - actual, actual - p90) AS score FROM bands), c AS (SELECT series_id, count(*) AS n,
  list_sort(list(score)) AS l FROM s GROUP BY 1),
q AS (SELECT *, (n - 1) * least(1.0, 0.8 * (1 + 1.0 / n)) AS pos FROM c)
SELECT series_id, n, round(l[floor(pos)::INT + 1] + (l[least(floor(pos)::INT + 1,
  n - 1) + 1] - l[floor(pos)::INT + 1]) * (pos - floor(pos)), 6) AS interp,
  round(greatest(0.0, l[least(n, ceil((n + 1) * 0.8 - 1e-12))::INT]), 6) AS orderstat FROM q""")
def conformal_offsets(spark: SparkSession, d: str) -> DataFrame:
    b = i.bands(spark, d)
    a = cal.cqr_interp(b, ["series_id"]).select("series_id", F.col("n").cast("long").alias("n"), F.col("offset").alias("interp"))
    o = cal.cqr_orderstat(b, ["series_id"]).select("series_id", F.col("offset").alias("orderstat"))
    return rounded(a.join(o, "series_id"))


@query(f"""WITH RECURSIVE {i.BANDS}, c AS (SELECT series_id, day, avg(CASE WHEN actual BETWEEN p10 AND p90 THEN 1.0
  ELSE 0.0 END)::DOUBLE AS covered, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM bands GROUP BY 1, 2),
e AS (SELECT series_id, i, day, covered, CAST(0.8 AS DOUBLE) AS eta FROM c WHERE i = 1 UNION ALL
  SELECT c.series_id, c.i, c.day, c.covered, greatest(0.8, least(0.995, e.eta + 0.05 * (0.8 - e.covered))) FROM e JOIN c
  ON c.series_id = e.series_id AND c.i = e.i + 1)
SELECT series_id, day, round(eta, 6) AS eta FROM e""")
def online_level(spark: SparkSession, d: str) -> DataFrame:
    b = i.bands(spark, d).groupBy("series_id", "day").agg(F.avg(F.col("actual").between(F.col("p10"), F.col("p90")).cast("double")).alias("covered"))
    return rounded(cal.online_level(b), "eta", digits=6)
