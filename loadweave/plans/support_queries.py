"""Joins, shapes, rules, conformal bands and allocation reports on the driver tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtests, calibration, control, evaluations, features, integrity, ledger, metrics, models, relations, resample, studies
from ..sources import catalog, counters, prices, remote
from . import inputs as i
from .registry import query, rounded, stirred

START = "TIMESTAMP '2024-01-01'"


def _at(hours: Column | None = None, mins: Column | None = None) -> Column:
    return F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=hours, mins=mins)


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as hourly prices."""
    return i.table(spark, d, "supplier").select(_at(F.col("s_suppkey").cast("int")).alias("ts"), F.col("s_acctbal").alias("price"))


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    """Parts as quarter hours."""
    return i.table(spark, d, "part").select("p_partkey", _at(mins=F.col("p_partkey").cast("int") * 15).alias("ts"))


# --- joins and choices --------------------------------------------------------------------------
@query("SELECT c_custkey AS pos, round(c_acctbal, 6) AS rebap, round(c_nationkey * 10.5, 6)::DOUBLE AS spot FROM customer WHERE c_custkey % 7 <> 3")
def positional_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = i.table(spark, d, "customer")
    left = c.select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 7 != 3, F.col("c_acctbal")).otherwise(F.lit(float("nan"))).alias("price"))
    return rounded(relations.positional_pairs(left, c.select(F.col("c_custkey").alias("pos"), (F.col("c_nationkey") * 10.5).alias("price"))))


@query(f"""WITH p AS (SELECT {START} + INTERVAL (s_suppkey) HOUR AS h, s_acctbal AS price FROM supplier),
  q AS (SELECT p_partkey, {START} + INTERVAL (p_partkey * 15) MINUTE AS ts FROM part)
SELECT p_partkey, round(price, 6) AS price FROM q LEFT JOIN p ON date_trunc('hour', ts) = h""")
def hours_of_prices(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.hours_of_prices(_quarters(spark, d), _hourly(spark, d)).select("p_partkey", "price"))


@query(f"SELECT p_partkey FROM part WHERE {START} + INTERVAL (p_partkey * 15) MINUTE IN (SELECT {START} + INTERVAL (s_suppkey) HOUR FROM supplier)")
def common_times(spark: SparkSession, d: str) -> DataFrame:
    return relations.common_times(_quarters(spark, d), _hourly(spark, d)).select("p_partkey")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC,
  o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def keep_last(spark: SparkSession, d: str) -> DataFrame:
    return relations.keep_last(i.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT s_nationkey AS component, s_suppkey AS representative, members FROM (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS members,
row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 7 DESC, s_acctbal DESC, s_suppkey DESC) AS k FROM supplier) WHERE k = 1""")
def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    s = i.table(spark, d, "supplier")
    entries = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7).alias("n_hours"), F.col("s_acctbal").alias("mean_load"))
    return relations.representatives(entries, s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("component")))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def keep_reference(spark: SparkSession, d: str) -> DataFrame:
    stored = i.table(spark, d, "supplier").select(F.col("s_nationkey").alias("utility"))
    new = i.table(spark, d, "customer").select(F.col("c_nationkey").alias("utility"), "c_custkey", "c_nationkey")
    return ledger.keep_reference(stored, new).select("c_custkey", "c_nationkey")


@query("""SELECT o_custkey AS household_id, min(CAST(o_orderdate AS DATE))::VARCHAR AS first_day, count(*) AS days FROM orders GROUP BY 1
HAVING min(o_orderdate) <= TIMESTAMP '1997-06-30' AND max(o_orderdate) >= TIMESTAMP '1998-06-30' AND count(*) >= 5 ORDER BY days DESC,
  household_id LIMIT 25""")
def archive_candidates(spark: SparkSession, d: str) -> DataFrame:
    o = i.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("household_id")).agg(
        F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"), F.count("*").alias("days")
    )
    return counters.candidates(o, "1997-06-30", "1998-06-30", 5, 25).select("household_id", F.col("first_day").cast("string").alias("first_day"), "days")


@query(f"SELECT p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def first_price_per_time(spark: SparkSession, d: str) -> DataFrame:
    p = i.table(spark, d, "part").select(F.col("p_size").alias("ts"), F.col("p_partkey").alias("pos"))
    return prices.first_per_time(p).select(F.col("ts").alias("p_size"), F.col("pos").alias("p_partkey"))


# --- shapes -------------------------------------------------------------------------------------
WEATHER = f"""wx AS (SELECT CAST(ts AS DATE) AS local_date, hour(ts)::INT AS hour, avg(temp) AS temp FROM
  (SELECT {START} + INTERVAL (p_partkey % 600) HOUR AS ts, p_size * 1.0 AS temp FROM part WHERE p_partkey % 200 <> 17) GROUP BY 1, 2)"""
# parts whose temperature is missing count for nothing


def _weather(spark: SparkSession, d: str) -> DataFrame:
    """All parts as hourly temperatures of 25 days; some are null, so that hours are missing."""
    temp = F.when(F.col("p_partkey") % 200 != 17, F.col("p_size") * 1.0)
    return i.table(spark, d, "part").select(_at((F.col("p_partkey") % 600).cast("int")).alias("ts"), temp.alias("temp"))


@query(f"""WITH {i.DAYS}, {WEATHER} SELECT series_id, day_idx, d.hour, round(temp, 6) AS temp FROM days d LEFT JOIN wx
  ON wx.local_date = d.local_date AND wx.hour = d.hour""")
def weather_on_days(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.weather_on_days(i.days(spark, d), _weather(spark, d), ["temp"]).select("series_id", "day_idx", "hour", "temp"))


@query(f"""WITH {i.DAYS}, {WEATHER}, full_days AS (SELECT local_date FROM wx GROUP BY 1 HAVING count(*) = 24)
SELECT series_id, CAST(dense_rank() OVER (PARTITION BY series_id ORDER BY local_date) - 1 AS INT) AS day_idx,
  CAST(local_date AS VARCHAR) AS local_date, hour FROM days WHERE local_date IN (SELECT local_date FROM full_days)""")
def days_with_weather(spark: SparkSession, d: str) -> DataFrame:
    x = resample.days_with_weather(i.days(spark, d), _weather(spark, d))
    return x.select("series_id", "day_idx", F.col("local_date").cast("string").alias("local_date"), "hour")


@query(f"""WITH {i.DAYS}, {WEATHER}, w AS (SELECT d.*, temp FROM days d LEFT JOIN wx ON wx.local_date = d.local_date AND wx.hour = d.hour),
m AS (SELECT *, avg(value) OVER (PARTITION BY series_id, day_idx) AS dm FROM w),
l AS (SELECT series_id, day_idx, hour, temp, lag(value, 1) OVER q - lag(value, 8) OVER q AS dev_prev,
  lag(dm, 1) OVER q - lag(dm, 8) OVER q AS dev_mean, value - lag(value, 7) OVER q AS target FROM m WINDOW q AS (PARTITION BY series_id,
  hour ORDER BY day_idx))
SELECT series_id, day_idx, hour, round(dev_prev, 6) AS dev_prev, round(dev_mean, 6) AS dev_mean, round(temp, 6) AS temp,
  round(target, 6) AS target FROM l WHERE day_idx >= 8 AND temp IS NOT NULL""")
def features_with_weather(spark: SparkSession, d: str) -> DataFrame:
    days = resample.weather_on_days(i.days(spark, d), _weather(spark, d), ["temp"])
    x = models.with_vector(features.features(days), [*features.FEATURES, "temp"])
    return rounded(x.select("series_id", "day_idx", "hour", F.col("x")[1].alias("dev_prev"), F.col("x")[2].alias("dev_mean"), F.element_at("x", -1).alias("temp"), "target"))


@query(f"""WITH {i.DAYS}, l AS (SELECT series_id, day_idx, hour, local_date, lag(value, 2) OVER q - lag(value, 9) OVER q AS lag2,
  avg(value) OVER (q ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - lag(value, 7) OVER q AS roll3
  FROM days WINDOW q AS (PARTITION BY series_id, hour ORDER BY day_idx))
SELECT series_id, day_idx, hour, round(lag2, 6) AS lag2, round(roll3, 6) AS roll3, round(CASE WHEN isodow(local_date) >= 6
  THEN exp(-pow(hour - 19.0, 2) / 8) ELSE 0 END, 6)::DOUBLE AS weekend_evening FROM l WHERE day_idx >= 9""")
def extended_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.extended_features(i.days(spark, d)).select("series_id", "day_idx", "hour", *features.EXTENDED))


@query("""WITH p AS (SELECT date_trunc('hour', ts) AS ts, avg(value) FILTER (event_type = 'view') AS "view",
  avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'error') AS error FROM events GROUP BY 1)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round("view", 6) AS "view", round(click, 6) AS click, round(error, 6) AS error,
  round("view" + click + error, 6) AS total FROM p WHERE "view" IS NOT NULL AND click IS NOT NULL AND error IS NOT NULL""")
def generation_frame(spark: SparkSession, d: str) -> DataFrame:
    x = resample.generation_frame(i.events(spark, d).select("ts", F.col("series_id").alias("part"), "value"), ["view", "click", "error"])
    return rounded(x.withColumn("ts", i.stamp("ts")))


@query("SELECT n_nationkey, h::INT AS hour, n_nationkey * 1.5::DOUBLE AS value FROM nation, range(24) t(h)")
def scalar_to_horizon(spark: SparkSession, d: str) -> DataFrame:
    n = i.table(spark, d, "nation").select("n_nationkey")
    return resample.scalar_to_horizon(n, F.col("n_nationkey") * 1.5).select("n_nationkey", "hour", "value")


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS ts, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(sum(v), 6) AS value FROM h GROUP BY ts HAVING count(v) = 5""")
def sum_where_all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.sum_where_all(resample.hourly_sum(i.events(spark, d)), 5).withColumn("ts", i.stamp("ts")))


@query("""SELECT s_suppkey % 24 AS ts, round(sum(CASE WHEN s_suppkey % 5 <> 0
  THEN s_acctbal * (1 + s_nationkey) END) / nullif(sum(CASE WHEN s_suppkey % 5 <> 0 THEN 1.0 + s_nationkey END), 0), 6) AS temp
  FROM supplier GROUP BY 1""")
def weighted_locations(spark: SparkSession, d: str) -> DataFrame:
    s = i.table(spark, d, "supplier").select(
        (F.col("s_suppkey") % 24).alias("ts"), (1.0 + F.col("s_nationkey")).alias("weight"),
        F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("temp")
    )
    return rounded(resample.weighted_locations(s, ["temp"]))


@query(f"""WITH {i.LOAD}, e AS (SELECT event_type AS series_id, min(ts) AS lo FROM events WHERE ts >= TIMESTAMP '2024-01-04' GROUP BY 1)
SELECT l.series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM load l JOIN e ON e.series_id = l.series_id WHERE ts < lo""")
def unmatched_leading(spark: SparkSession, d: str) -> DataFrame:
    e = i.events(spark, d).where("ts >= '2024-01-04'").groupBy("series_id", "ts").agg(F.max("value").alias("value"))
    x = resample.as_of(i.load(spark, d).select("series_id", "ts"), e)
    return resample.unmatched_leading(x, "asof_value").select("series_id", i.stamp("ts").alias("ts"))


@query(f"""WITH {i.LOAD}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS k,
  count(*) OVER (PARTITION BY series_id) AS n FROM load WHERE ts >= TIMESTAMP '2024-01-02 05:00:00')
SELECT series_id, (k // 24)::INT AS day_idx, (k % 24)::INT AS hour, CAST(CAST(min(ts) OVER (PARTITION BY series_id,
  k // 24) AS DATE) AS VARCHAR) AS local_date, round(value, 6) AS value FROM x WHERE k < n - n % 24""")
def contiguous_blocks(spark: SparkSession, d: str) -> DataFrame:
    x = resample.contiguous_blocks(i.load(spark, d).where("ts >= '2024-01-02 05:00:00'"))
    return rounded(x.withColumn("local_date", F.col("local_date").cast("string")))


@query(f"""WITH {i.LOAD}, q AS (SELECT series_id, ts + INTERVAL (15 * (k + 1)) MINUTE AS ts, value * (k + 1) AS value FROM load, range(4) t(k)
  WHERE NOT (hour(ts) = 3 AND day(ts) % 10 = 5 AND k = 2)),
s AS (SELECT series_id, CAST(ts - INTERVAL 15 MINUTE AS DATE) AS d,
  (hour(ts - INTERVAL 15 MINUTE) * 4 + minute(ts - INTERVAL 15 MINUTE) // 15)::INT AS slot, value FROM q),
f AS (SELECT *, count(*) OVER (PARTITION BY series_id, d) AS n FROM s)
SELECT series_id, CAST(dense_rank() OVER (PARTITION BY series_id ORDER BY d) - 1 AS INT) AS day_idx, slot, round(value, 6) AS value FROM f
  WHERE n = 96""")
def quarter_hour_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Four readings an hour; some have no value, so that their days aren't whole."""
    q = i.load(spark, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    value = F.when(F.expr("not (hour(ts) = 3 and day(ts) % 10 = 5 and k = 2)"), F.col("value") * (F.col("k") + 1))
    q = q.select("series_id", (F.col("ts") + F.make_dt_interval(mins=15 * (F.col("k") + 1))).alias("ts"), value.alias("value"))
    return rounded(resample.quarter_hour_matrix(q).select("series_id", "day_idx", "slot", "value"))


@query(f"""WITH {i.LOAD} SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
  round(avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS value FROM load""")
def mock_wind(spark: SparkSession, d: str) -> DataFrame:
    return rounded(catalog.mock_wind(i.load(spark, d)).select("series_id", i.stamp("ts").alias("ts"), "value"))


@query(f"""WITH {i.LOAD}, q AS (SELECT series_id, date_trunc('hour', ts) AS ts, value + k AS v FROM load, range(4) t(k) WHERE NOT (k = 1
  AND hour(ts) % 5 = 0))
SELECT series_id AS household_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(sum(v), 6) AS value FROM q GROUP BY 1, q.ts HAVING count(*) = 4""")
def household_hours(spark: SparkSession, d: str) -> DataFrame:
    """Four readings an hour; some have no value, so that their hours aren't whole."""
    q = i.load(spark, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    q = q.select(
        F.col("series_id").alias("household_id"), (F.col("ts") + F.make_dt_interval(mins=15 * F.col("k"))).alias("ts"),
        F.when(F.expr("not (k = 1 and hour(ts) % 5 = 0)"), F.col("value") + F.col("k")).alias("value")
    )
    return rounded(counters.household_hours(q).withColumn("ts", i.stamp("ts")))


@query("SELECT l_linenumber AS ts, round(sum(l_quantity * 1000) / 500000, 6) AS value FROM lineitem GROUP BY 1")
def half_hours_to_mw(spark: SparkSession, d: str) -> DataFrame:
    x = i.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("ts"), F.col("l_suppkey").alias("area"), (F.col("l_quantity") * 1000).alias("wh"))
    return rounded(remote.half_hours_to_mw(x))


@query(f"""WITH t AS (SELECT p_partkey, {START} + INTERVAL (p_partkey % 2000) HOUR AS local, p_partkey % 9000 + 0.25 AS under,
  CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 9000 + 1.75 ELSE p_partkey % 9000 + 0.25 END AS over FROM part)
SELECT p_partkey, strftime(local - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ts, under::DOUBLE AS under, over::DOUBLE AS over FROM t""")
def official_prices(spark: SparkSession, d: str) -> DataFrame:
    return _official(spark, d).withColumn("ts", i.stamp("ts"))


def _official(spark: SparkSession, d: str) -> DataFrame:
    """Parts as lines of the official price file: winter hours, German numbers."""
    key = F.col("p_partkey") % 9000
    german = lambda x: F.translate(F.format_number(x, 2), ",.", ".,")
    local = _at((F.col("p_partkey") % 2000).cast("int"))
    p = i.table(spark, d, "part").select(
        "p_partkey", F.date_format(local, "dd.MM.yyyy").alias("Datum"), F.date_format(local, "HH:mm").alias("von"), F.lit("CET").alias("Zeitzone"),
        german(key + 0.25).alias("low"), german(F.when(F.col("p_partkey") % 10 == 0, key + 1.75).otherwise(key + 0.25)).alias("high"),
    )
    # lines are keyed by their text here; the normaliser keeps the three columns that it makes
    return prices.normalise_official(p, "low", "high", keep=["p_partkey"])


@query("SELECT count(*) AS n, count(*) FILTER (p_partkey % 10 = 0) AS n_asymmetric, 1.5::DOUBLE AS max_difference FROM part")
def price_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    return rounded(prices.asymmetry(_official(spark, d)))


@query(f"""WITH t AS (SELECT p_partkey AS pos, {START} + INTERVAL (p_partkey // 2) HOUR AS l FROM part),
y AS (SELECT DISTINCT year(l) AS y FROM t),
b AS (SELECT y, make_date(y, 3, 31) - (isodow(make_date(y, 3, 31)) % 7)::INT + INTERVAL 2 HOUR AS spring,
  make_date(y, 10, 31) - (isodow(make_date(y, 10, 31)) % 7)::INT + INTERVAL 2 HOUR AS autumn FROM y),
n AS (SELECT pos, l, row_number() OVER (PARTITION BY l ORDER BY pos) AS k FROM t)
SELECT pos, strftime(CASE WHEN l >= spring AND l < spring + INTERVAL 1 HOUR THEN spring - INTERVAL 1 HOUR
  WHEN l > spring AND (l < autumn OR (l < autumn + INTERVAL 1 HOUR AND k = 1)) THEN l - INTERVAL 2 HOUR
  ELSE l - INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS ts FROM n JOIN b ON year(l) = y""")
def local_prices(spark: SparkSession, d: str) -> DataFrame:
    """All parts as local half hours' prices, through winter, summer and the nights between."""
    p = i.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), _at(F.expr("cast(p_partkey div 2 as int)")).alias("local"))
    return prices.local_prices(p).select("pos", i.stamp("ts").alias("ts"))


# --- rules --------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT p_brand AS key, 8000 + sum(p_size) * 400 AS samples, 200 + count(*) * 2 AS days,
  (min(p_partkey) % 3 + 1) * 1.0 AS per_hour, avg(p_retailprice - 1000) AS mean, stddev_pop(p_retailprice) AS std FROM part GROUP BY 1)
SELECT key, samples >= CASE WHEN per_hour >= 4 THEN 34000 WHEN per_hour >= 2 THEN 17000 ELSE 8000 END AND days >= 300 AS qualified,
  abs(mean) > std * 0.1 AS mape_useful FROM s""")
def corpus_qualification(spark: SparkSession, d: str) -> DataFrame:
    s = i.table(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(
        (8000 + F.sum("p_size") * 400).alias("samples"), (200 + F.count("*") * 2).alias("days"), ((F.min("p_partkey") % 3 + 1) * 1.0).alias("per_hour"),
        F.avg(F.col("p_retailprice") - 1000).alias("mean"), F.stddev_pop("p_retailprice").alias("std"),
    )
    return catalog.qualify(s).select("key", "qualified", "mape_useful")


@query("""SELECT o_orderpriority AS sigma, count(*) AS runs, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std,
  round(min(o_totalprice), 4) AS "min", round(max(o_totalprice), 4) AS "max",
round(avg(CASE WHEN o_totalprice < 200000 + o_custkey THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS win_rate FROM orders GROUP BY 1""")
def sweep_summary(spark: SparkSession, d: str) -> DataFrame:
    o = i.table(spark, d, "orders").select(F.col("o_orderpriority").alias("sigma"), "o_totalprice", (200000.0 + F.col("o_custkey")).alias("reference"))
    return rounded(rounded(studies.sweep_summary(o, ["sigma"], "o_totalprice", "reference"), "win_rate"), "mean", "std", "min", "max", digits=4)


@query("""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1), s AS (SELECT m.event_type, any_value(med) AS med,
  quantile_cont(abs(value - med), 0.5) * 1.4826 AS sigma FROM events e JOIN m ON m.event_type = e.event_type GROUP BY 1),
b AS (SELECT e.event_type AS series_id, e.ts, e.value, row_number() OVER (PARTITION BY e.event_type ORDER BY e.ts) AS k FROM events e JOIN s
  ON s.event_type = e.event_type WHERE abs(e.value - med) > 3 * sigma)
SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value FROM b WHERE k <= 4""")
def issue_samples(spark: SparkSession, d: str) -> DataFrame:
    x = integrity.issue_samples(integrity.point_checks(i.events(spark, d), mad_k=3.0), 4)
    return rounded(x.select("series_id", i.stamp("ts").alias("ts"), "value"))


GATED = f"""{i.LOAD}, bad AS (SELECT *, CASE WHEN series_id < 'p' AND hour(ts) = 7 AND day(ts) % 9 = 4 THEN -5.0 ELSE value END AS v FROM load),
x AS (SELECT *, CASE WHEN v >= 0 THEN v END AS ok FROM bad),
y AS (SELECT *, coalesce(lag(ok, 24) OVER w, lead(ok, 24) OVER w, lag(ok, 48) OVER w, lead(ok, 48) OVER w, lag(ok, 72) OVER w,
  lead(ok, 72) OVER w) AS seasonal FROM x WINDOW w AS (PARTITION BY series_id ORDER BY ts))"""


@query(f"""WITH {GATED} SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(CASE WHEN ok IS NULL THEN round(seasonal, 4)
  ELSE v END, 4) AS clean, series_id < 'p' AS applied, count(*) FILTER (ok IS NULL) OVER (PARTITION BY series_id) AS n_filled FROM y""")
def validation_gate(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when((F.col("series_id") < "p") & (F.hour("ts") == 7) & (F.dayofmonth("ts") % 9 == 4), -5.0).otherwise(F.col("value"))
    x = integrity.validate(i.load(spark, d).withColumn("value", bad), mad_k=1e9)
    return rounded(x.select("series_id", i.stamp("ts").alias("ts"), "clean", "applied", "n_filled"), digits=4)


# --- forecasts of the base alone: values have two decimals and quantiles a few more, so rounding comes after those
@query(f"""WITH {i.BASED}, e AS (SELECT series_id, max(day_idx) + 1 AS new FROM days GROUP BY 1), h AS (SELECT t.series_id, t.day_idx, t.hour,
  quantile_cont(b.value - b.snaive, 0.1) AS lo, quantile_cont(b.value - b.snaive, 0.9) AS hi
  FROM based t JOIN e ON e.series_id = t.series_id AND t.day_idx >= new - 5 JOIN based b ON b.series_id = t.series_id AND b.hour = t.hour
  AND b.day_idx >= 8 AND b.day_idx < t.day_idx GROUP BY 1, 2, 3)
SELECT t.series_id, t.day_idx, t.hour, round(t.value, 8) AS actual, round(t.snaive, 8) AS model, round(t.snaive + lo, 8) AS p10,
  round(t.snaive + hi, 8) AS p90 FROM based t JOIN h ON h.series_id = t.series_id AND h.day_idx = t.day_idx AND h.hour = t.hour""")
def base_backtest(spark: SparkSession, d: str) -> DataFrame:
    x = models.rolling_origin(i.days(spark, d), 5, lams=())
    return rounded(x.select("series_id", "day_idx", "hour", "actual", "model", "p10", "p90"), digits=8)


BASE_FIT = """e AS (SELECT series_id, max(day_idx) + 1 AS new FROM days GROUP BY 1),
rq AS (SELECT b.series_id, b.hour, quantile_cont(value - snaive, 0.1) AS lo, quantile_cont(value - snaive, 0.9) AS hi FROM based b JOIN e
  ON e.series_id = b.series_id WHERE b.day_idx >= 8 AND b.day_idx < new - 7 GROUP BY 1, 2),
sc AS (SELECT b.series_id, greatest(snaive + lo - value, value - snaive - hi) AS s FROM based b JOIN e ON e.series_id = b.series_id JOIN rq
  ON rq.series_id = b.series_id AND rq.hour = b.hour WHERE b.day_idx >= new - 7),
cl AS (SELECT series_id, count(*) AS n, list_sort(list(s)) AS l FROM sc GROUP BY 1), cp AS (SELECT *,
  (n - 1) * least(1.0, 0.8 * (1 + 1.0 / n)) AS pos FROM cl),
cq AS (SELECT series_id, l[floor(pos)::INT + 1] + (l[least(floor(pos)::INT + 1, n - 1) + 1] - l[floor(pos)::INT + 1]) * (pos - floor(pos)) AS c
  FROM cp)"""


@query(f"""WITH {i.BASED}, {BASE_FIT} SELECT d.series_id, CAST(local_date + 7 AS VARCHAR) AS local_date, d.hour, round(value, 8) AS p50,
  round(least(value, value + lo - c), 8) AS p10, round(greatest(value, value + hi + c), 8) AS p90
FROM days d JOIN e ON e.series_id = d.series_id AND d.day_idx = new - 7 JOIN rq ON rq.series_id = d.series_id AND rq.hour = d.hour JOIN cq
  ON cq.series_id = d.series_id""")
def base_next_day(spark: SparkSession, d: str) -> DataFrame:
    x = models.next_day(i.days(spark, d), cal_days=7, lams=(), digits=None)
    return rounded(x.withColumn("local_date", F.col("local_date").cast("string")), digits=8)


@query(f"""WITH {i.BASED}, e AS (SELECT series_id, max(day_idx) + 1 AS new FROM days GROUP BY 1)
SELECT d.series_id, (d.day_idx - new + 8)::INT AS horizon, CAST(local_date + 7 AS VARCHAR) AS local_date, d.hour, round(value, 8) AS p50,
  d.day_idx = new - 7 AS banded FROM days d JOIN e ON e.series_id = d.series_id WHERE d.day_idx >= new - 7 AND d.day_idx < new - 3""")
def base_several_days(spark: SparkSession, d: str) -> DataFrame:
    x = models.several_days(i.days(spark, d), 4, cal_days=7, lams=(), digits=None)
    x = x.select("series_id", "horizon", F.col("local_date").cast("string").alias("local_date"), "hour", "p50", F.col("p10").isNotNull().alias("banded"))
    return rounded(x, digits=8)


def _conformal(kind: str) -> str:
    """Four test days, cuts seven days before each, scores of the days between and of the test days before."""
    score = "greatest(snaive + lo - value, value - snaive - hi)" if kind == "cqr" else "value - snaive"
    return f"""{i.BASED}, e AS (SELECT series_id, max(day_idx) + 1 AS new FROM days GROUP BY 1), t AS (SELECT series_id, new - 4 + k AS test,
  new - 11 + k AS cut FROM e, range(4) r(k)),
rq AS (SELECT t.series_id, test, b.hour, quantile_cont(value - snaive, 0.1) AS lo, quantile_cont(value - snaive, 0.9) AS hi FROM t JOIN based b
  ON b.series_id = t.series_id AND b.day_idx >= 8 AND b.day_idx < cut GROUP BY 1, 2, 3),
x AS (SELECT t.series_id, t.test, cut, b.day_idx, b.hour, value, snaive, lo, hi, {score} AS s FROM t JOIN based b ON b.series_id = t.series_id
  AND b.day_idx >= cut AND b.day_idx <= t.test JOIN rq ON rq.series_id = t.series_id AND rq.test = t.test AND rq.hour = b.hour),
sc AS (SELECT series_id, test, s FROM x WHERE day_idx < test UNION ALL SELECT t.series_id, t.test, x.s FROM t JOIN x ON x.series_id = t.series_id
  AND x.day_idx = x.test AND x.test < t.test)"""


@query(f"""WITH {_conformal("cqr")}, cl AS (SELECT series_id, test, count(*) AS n, list_sort(list(s)) AS l FROM sc GROUP BY 1, 2), cp AS (SELECT *,
  (n - 1) * least(1.0, 0.8 * (1 + 1.0 / n)) AS pos FROM cl),
cq AS (SELECT series_id, test, l[floor(pos)::INT + 1] + (l[least(floor(pos)::INT + 1,
  n - 1) + 1] - l[floor(pos)::INT + 1]) * (pos - floor(pos)) AS c FROM cp)
SELECT x.series_id, x.day_idx, x.hour, round(snaive, 8) AS model, round(snaive + lo - c, 8) AS p10, round(snaive + hi + c, 8) AS p90 FROM x
  JOIN cq ON cq.series_id = x.series_id AND cq.test = x.test WHERE x.day_idx = x.test""")
def base_cqr(spark: SparkSession, d: str) -> DataFrame:
    x = backtests.rolling_conformal(i.days(spark, d), 4, "cqr", cal_days=7, lams=())
    return rounded(x.select("series_id", "day_idx", "hour", "model", "p10", "p90"), digits=8)


@query(f"""WITH {_conformal("residual")}, q AS (SELECT series_id, test, quantile_cont(s, 0.1) AS a, quantile_cont(s, 0.9) AS b FROM sc GROUP BY 1, 2)
SELECT x.series_id, x.day_idx, x.hour, round(snaive, 8) AS model, round(snaive + a, 8) AS p10, round(snaive + b, 8) AS p90 FROM x JOIN q
  ON q.series_id = x.series_id AND q.test = x.test WHERE x.day_idx = x.test""")
def base_conformal(spark: SparkSession, d: str) -> DataFrame:
    x = backtests.rolling_conformal(i.days(spark, d), 4, "residual", cal_days=7, lams=())
    return rounded(x.select("series_id", "day_idx", "hour", "model", "p10", "p90"), digits=8)


@query()
def targeted_cqr(spark: SparkSession, d: str) -> DataFrame:
    return backtests.targeted_conformal(i.days(spark, d), 4, 0.8, cal_days=5)


@query()
def rolling_cqr(spark: SparkSession, d: str) -> DataFrame:
    return backtests.rolling_cqr(i.days(spark, d), 6, every=3, window=7, eta=0.05)


@query()
def horizon_bands(spark: SparkSession, d: str) -> DataFrame:
    return models.several_days(i.days(spark, d), 3, cal_days=7, bands="per_horizon")


# --- conformal pieces ---------------------------------------------------------------------------
@query(f"""WITH {i.BANDS}, s AS (SELECT series_id, greatest(p10 - actual, actual - p90) AS score FROM bands), c AS (SELECT series_id, count(*) AS n,
  list_sort(list(score)) AS l FROM s GROUP BY 1)
SELECT series_id, n::INT AS n, round(l[ceil((n - 1) * 0.8 - 1e-12)::INT + 1], 6) AS "offset" FROM c""")
def higher_quantile(spark: SparkSession, d: str) -> DataFrame:
    b = i.bands(spark, d).withColumn("score", calibration.cqr_score())
    return rounded(calibration.higher_quantile(b, ["series_id"], "score", 0.8))


@query(f"""WITH {i.BANDS}, f AS (SELECT DISTINCT series_id, day FROM bands), h AS (SELECT f.series_id, f.day, b.day AS past,
  abs(b.actual - b.p50) AS s FROM f JOIN bands b ON b.series_id = f.series_id AND b.day >= f.day - 7 AND b.day < f.day),
c AS (SELECT series_id, day, count(*) AS n, list_sort(list(s)) AS l FROM h GROUP BY 1, 2 HAVING count(DISTINCT past) >= 3), q AS (SELECT *,
  (n - 1) * least(1.0, 0.8 * (1 + 1.0 / n)) AS pos FROM c)
SELECT series_id, day, n::INT AS n, round(l[floor(pos)::INT + 1] + (l[least(floor(pos)::INT + 1,
  n - 1) + 1] - l[floor(pos)::INT + 1]) * (pos - floor(pos)), 6) AS "offset" FROM q""")
def rolling_offsets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calibration.rolling_conformal(i.bands(spark, d), window=7, least=3))


@query(f"""WITH {i.BANDS}, s AS (SELECT series_id, greatest(p10 - actual, actual - p90) AS score FROM bands), c AS (SELECT series_id, count(*) AS n,
  list_sort(list(score)) AS l FROM s GROUP BY 1),
o AS (SELECT series_id, greatest(0.0, l[least(n, ceil((n + 1) * 0.8 - 1e-12))::INT]) AS o FROM c)
SELECT b.series_id, day, hour, round(least(p50, p10 - o), 6) AS p10, round(p50, 6) AS p50, round(greatest(p50, p90 + o), 6) AS p90 FROM bands b
  JOIN o ON o.series_id = b.series_id""")
def widened_bands(spark: SparkSession, d: str) -> DataFrame:
    b = i.bands(spark, d)
    x = calibration.widen(b, calibration.cqr_orderstat(b, ["series_id"]), ["series_id"])
    return rounded(x.select("series_id", "day", "hour", "p10", "p50", "p90"))


@query(f"""WITH {i.BANDS}, s AS (SELECT series_id, day % 2 = 0 AS fit, greatest(p10 - actual, actual - p90) AS score FROM bands),
  c AS (SELECT series_id, count(*) AS n, list_sort(list(score)) AS l FROM s WHERE fit GROUP BY 1),
a AS (SELECT unnest([0.2, 0.2 * 0.7, 0.2 * 0.5, 0.2 * 0.35, 0.2 * 0.25])::DOUBLE AS alpha, unnest([0, 1, 2, 3, 4]) AS k), p AS (SELECT c.*, alpha,
  k, (n - 1) * least(1.0, (1 - alpha) * (1 + 1.0 / n)) AS pos FROM c, a),
o AS (SELECT series_id, alpha, k, l[floor(pos)::INT + 1] + (l[least(floor(pos)::INT + 1,
  n - 1) + 1] - l[floor(pos)::INT + 1]) * (pos - floor(pos)) AS o FROM p),
v AS (SELECT o.series_id, k, any_value(alpha) AS alpha, any_value(o) AS o, avg(CASE WHEN score <= o THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage
  FROM o JOIN s ON s.series_id = o.series_id AND NOT fit GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY CASE WHEN coverage >= 0.9 THEN k ELSE 100 - k END) AS i FROM v)
SELECT series_id, round(alpha, 6) AS alpha, round(o, 6) AS "offset", round(coverage, 6) AS coverage FROM r WHERE i = 1""")
def target_alpha(spark: SparkSession, d: str) -> DataFrame:
    b = i.bands(spark, d).withColumn("score", calibration.cqr_score()).withColumn("half", F.when(F.col("day") % 2 == 0, "fit").otherwise("check"))
    return rounded(calibration.target_alpha(b, ["series_id"], target=0.9))


@query(f"""WITH {i.BASED}, r AS (SELECT series_id, local_date, avg(abs(value - persist)) AS mae FROM based WHERE snaive IS NOT NULL GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY local_date DESC) AS k FROM r)
SELECT series_id, CAST(local_date AS VARCHAR) AS target_date, round(mae, 6) AS mae FROM k WHERE k <= 5""")
def record_last_days(spark: SparkSession, d: str) -> DataFrame:
    x = i.based(spark, d).where("snaive is not null").groupBy("series_id", F.col("local_date").cast("string").alias("target_date")).agg(F.avg(F.abs(F.col("value") - F.col("persist"))).alias("mae"))
    return rounded(ledger.last_days(x, 5))


# --- allocation reports -------------------------------------------------------------------------
@query("""SELECT c_nationkey AS pool_id, c_custkey AS device_id, CASE WHEN c_custkey % 4 = 0 THEN 4.2
  ELSE (c_custkey % 5) * 1.0 END::DOUBLE AS floor_kw, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE (c_custkey % 3) - 1.0 END::DOUBLE AS weight,
c_acctbal >= 0 AND CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE (c_custkey % 3) - 1.0 END > 0 AS valid,
  CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS device_index FROM customer""")
def normalised_devices(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = i.table(spark, d, "customer").select(
        F.col("c_nationkey").alias("pool_id"), k.alias("device_id"), F.col("c_acctbal").alias("demand_kw"), F.when(k % 4 != 0, (k % 5) * 1.0).alias("floor_kw"), F.when(k % 3 != 0, (k % 3) - 1.0).alias("weight")
    )
    return control.normalise_devices(c, by=["pool_id"]).drop("demand_kw")


@query(f"""WITH {i.DEVICES} SELECT feeder_id AS pool_id, round(sum(least(floor_kw, demand_kw)), 6)::DOUBLE AS least_kw,
  round(sum(demand_kw), 6) AS most_kw FROM devices GROUP BY 1""")
def pool_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(control.pool_band(i.devices(spark, d).withColumnRenamed("feeder_id", "pool_id")))


@query("""WITH h AS (SELECT l_suppkey % 20 AS feeder_id, l_linenumber AS hour, max(l_extendedprice) AS p90 FROM lineitem GROUP BY 1, 2)
SELECT feeder_id, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS n_hours,
  round(greatest(0, 2 * 90000.0 - max(p90)), 4)::DOUBLE AS cap FROM h WHERE p90 > 90000 GROUP BY 1""")
def congestion_window(spark: SparkSession, d: str) -> DataFrame:
    h = i.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("feeder_id"), F.col("l_linenumber").alias("hour")).agg(F.max("l_extendedprice").alias("p90"))
    return rounded(control.congestion_window(h, 90000.0), digits=4)


@query("""SELECT o_orderpriority AS feeder_id, round(sum(o_totalprice / 10), 4) AS shed, round(sum(o_totalprice), 4) AS naive,
  count(*) FILTER (o_orderstatus = 'O') AS hours, 90.0::DOUBLE AS saved_percent FROM orders GROUP BY 1""")
def energy_saved(spark: SparkSession, d: str) -> DataFrame:
    o = i.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("feeder_id"), (F.col("o_totalprice") / 10).alias("shed_kw"),
        F.col("o_totalprice").alias("naive_shed_kw"), (F.col("o_orderstatus") == "O").alias("congested")
    )
    return rounded(control.energy_saved(o), digits=4)


@query("""SELECT l_suppkey AS asset_id, l_linenumber AS hour, 'redispatch' AS decision_type,
  l_discount AS magnitude_kw, 60::INT AS duration_min, 'v1' AS rule_version FROM lineitem WHERE l_discount > 1e-9""")
def interventions(spark: SparkSession, d: str) -> DataFrame:
    x = i.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("asset"), F.col("l_linenumber").alias("hour"), F.col("l_discount").alias("shed"))
    return ledger.interventions(x, "redispatch", "shed", "asset", rule_version="v1")


POINTS = """pt AS (SELECT 'DE' || lpad(CAST(o_custkey AS VARCHAR), 3 + (o_custkey % 4)::INT, '0') AS malo, o_orderdate AS a, o_orderdate + INTERVAL (o_orderkey % 3) HOUR AS b, (o_orderkey % 11) * 1.0 AS lim, CASE WHEN o_orderkey % 2 = 0 THEN 3.0 END AS fl, o_orderkey FROM orders)"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    o, key = i.table(spark, d, "orders"), F.col("o_orderkey")
    cust = F.col("o_custkey").cast("string")
    return o.select(
        F.concat(F.lit("DE"), F.expr("lpad(cast(o_custkey as string), 3 + cast(o_custkey % 4 as int), '0')")).alias("malo"), F.col("o_orderdate").cast("timestamp").alias("start_ts"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(key % 3).cast("int"))).alias("end_ts"), ((key % 11) * 1.0).alias("p_limit_kw"), F.when(key % 2 == 0, 3.0).alias("floor_kw"), "o_orderkey",
    )


@query(f"""WITH {POINTS} SELECT o_orderkey, concat_ws(',', CASE WHEN length(malo) < 6 THEN 'short_id' END, CASE WHEN lim < coalesce(fl, 4.2)
  THEN 'below_floor' END, CASE WHEN b <= a THEN 'no_duration' END) AS errors FROM pt""")
def schedule_errors(spark: SparkSession, d: str) -> DataFrame:
    return control.validate_schedule(_points(spark, d)).select("o_orderkey", F.array_join("errors", ",").alias("errors"))


@query(f"""WITH {POINTS} SELECT malo, strftime(a, '%Y-%m-%d %H:%M:%S') AS start_ts, (lim * 1000)::DOUBLE AS limit_w, date_diff('second', a,
  b) AS duration_s, (min(coalesce(fl, 4.2)) OVER (PARTITION BY malo) * 1000)::DOUBLE AS failsafe_w FROM pt""")
def lpc_points(spark: SparkSession, d: str) -> DataFrame:
    return control.to_lpc(_points(spark, d)).withColumn("start_ts", i.stamp("start_ts"))


@query(f"WITH {POINTS} SELECT o_orderkey, lim >= 4.2 AS accepted, CASE WHEN lim >= 4.2 THEN least(6.0, lim) END::DOUBLE AS applied_kw FROM pt")
def received_limits(spark: SparkSession, d: str) -> DataFrame:
    return control.receive(_points(spark, d).withColumn("desired_kw", F.lit(6.0))).select("o_orderkey", "accepted", "applied_kw")


@query(f"""WITH {i.SCENARIOS}, b AS (SELECT asset_id, hour, any_value(point_kw) AS base, quantile_cont(r, 0.75) AS q,
  (hour % 5) * 0.1 AS fee, 400.0 AS thr FROM scen GROUP BY 1, 2),
c AS (SELECT *, greatest(0, least(60.0, greatest(0, thr - base))) AS ceil_ FROM b), p AS (SELECT *, greatest(0,
  least(ceil_, 500.0 - coalesce(sum(ceil_) OVER (PARTITION BY asset_id ORDER BY fee, hour ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0))) AS kwh FROM c)
SELECT asset_id AS plan_id, hour, round(kwh, 6) + 0.0 AS kwh, round(base + kwh + q, 6) AS nomination_kw, base + kwh <= thr + 1e-9 AS grid_safe
  FROM p""")
def day_plan(spark: SparkSession, d: str) -> DataFrame:
    x = i.scenarios(spark, d).select(
        F.col("asset_id").alias("plan_id"), "hour", F.col("point_kw").alias("base_kw"), "residuals",
        ((F.col("hour") % 5) * 0.1).alias("fee"), F.lit(60.0).alias("p_max_kw"), F.lit(500.0).alias("energy_kwh")
    )
    return rounded(control.plan_day(x, 400.0, 3.0, 1.0).select("plan_id", "hour", "kwh", "nomination_kw", "grid_safe"))


# --- evaluations --------------------------------------------------------------------------------
@query(f"""WITH {i.SETTLEMENT}, dy AS (SELECT grp, day, sum((sched_b - sched_a) * (rebap - spot)) AS g FROM settlement GROUP BY 1, 2),
  p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY day) - 1 AS pos FROM dy),
blk AS (SELECT grp, pos // 7 AS block, sum(g) AS g FROM p GROUP BY 1, 2), arr AS (SELECT grp, list(g ORDER BY block) AS g, count(*) AS b
  FROM blk GROUP BY 1),
st0 AS (SELECT rep, (rep + 7000)::BIGINT AS z FROM range(200) t(rep)), st AS (SELECT rep, {stirred("z")} AS z FROM st0),
pl0 AS (SELECT grp, rep, b, g AS gs, (z + k * 7919) % 4294967296 AS z FROM arr, st, range(2000) t(k) WHERE k < b), pl AS (SELECT *,
  ({stirred("z")}) % b AS pick FROM pl0),
dr AS (SELECT grp, rep, sum(gs[pick + 1]) AS g FROM pl GROUP BY 1, 2), bd AS (SELECT grp, quantile_cont(g, 0.1) AS p10,
  quantile_cont(g, 0.5) AS p50, quantile_cont(g, 0.9) AS p90, avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) AS pp FROM dr GROUP BY 1),
x AS (SELECT grp, count(DISTINCT day) AS n_days, sum((actual - sched_a) * (rebap - spot)) - sum((actual - sched_b) * (rebap - spot)) AS saving
  FROM settlement GROUP BY 1)
SELECT grp, n_days, round(saving, 3) AS saving, round(p10, 3) AS p10, round(p50, 3) AS p50, round(p90, 3) AS p90,
  round(pp, 6)::DOUBLE AS p_positive FROM x JOIN bd USING (grp)""")
def settlement_bands(spark: SparkSession, d: str) -> DataFrame:
    x = evaluations.settlement_band(i.settlement(spark, d), ["grp"], "sched_a", "sched_b", "actual", "rebap", "spot", "day", n_boot=200)
    return rounded(rounded(x.select("grp", "n_days", "saving", "p10", "p50", "p90", "p_positive"), "p_positive"), "saving", "p10", "p50", "p90", digits=3)


@query(f"""WITH {i.BASED}, e AS (SELECT series_id, max(day_idx) + 1 AS new FROM days GROUP BY 1), h AS (SELECT t.series_id, t.day_idx, t.hour,
  quantile_cont(b.value - b.snaive, 0.1) AS lo, quantile_cont(b.value - b.snaive, 0.9) AS hi
  FROM based t JOIN e ON e.series_id = t.series_id AND t.day_idx >= new - 13 JOIN based b ON b.series_id = t.series_id AND b.hour = t.hour
  AND b.day_idx >= 8 AND b.day_idx < t.day_idx GROUP BY 1, 2, 3),
r AS (SELECT t.series_id, t.day_idx AS day, t.hour, t.value AS actual, t.snaive AS p50, t.snaive + lo AS p10, t.snaive + hi AS p90, new
  FROM based t JOIN h ON h.series_id = t.series_id AND h.day_idx = t.day_idx AND h.hour = t.hour JOIN e ON e.series_id = t.series_id),
g AS (SELECT 0.3 + 2.7 * k / 135.0 AS s FROM range(136) t(k)),
w AS (SELECT f.series_id, f.day AS for_day, s, avg(CASE WHEN actual < p50 - s * (p50 - p10) THEN 1.0 ELSE 0.0 END) AS lo,
  avg(CASE WHEN actual > p50 + s * (p90 - p50) THEN 1.0 ELSE 0.0 END) AS hi
  FROM (SELECT DISTINCT series_id, day, new FROM r WHERE day >= new - 6) f JOIN r ON r.series_id = f.series_id AND r.day >= f.day - 7
  AND r.day < f.day, g GROUP BY 1, 2, 3),
b AS (SELECT series_id, for_day, arg_min(s, (round(abs(lo - 0.1), 12), s)) AS l, arg_min(s, (round(abs(hi - 0.1), 12), s)) AS u FROM w GROUP BY 1, 2),
c AS (SELECT r.*, p50 - (1 + 0.5 * (l - 1)) * (p50 - p10) AS clo, p50 + (1 + 0.5 * (u - 1)) * (p90 - p50) AS chi FROM r JOIN b
  ON b.series_id = r.series_id AND b.for_day = r.day)
SELECT series_id, count(*) AS n, round(100 * avg(CASE WHEN actual BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS coverage,
  round(100 * avg(CASE WHEN actual BETWEEN clo AND chi THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS coverage_cal,
  round(100 * avg(CASE WHEN actual < clo THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS below_cal, round(100 * avg(CASE WHEN actual > chi THEN 1.0
  ELSE 0.0 END), 6)::DOUBLE AS above_cal FROM c GROUP BY 1""")
def base_calibration(spark: SparkSession, d: str) -> DataFrame:
    x = models.rolling_origin(i.days(spark, d), 6, lams=(), calibrate=True, window=7)
    return rounded(evaluations.calibration_summary(x).select("series_id", "n", "coverage", "coverage_cal", "below_cal", "above_cal"))


@query()
def weather_lift(spark: SparkSession, d: str) -> DataFrame:
    days = resample.weather_on_days(i.days(spark, d), _weather(spark, d), ["temp"])
    return evaluations.weather_lift(days, ["temp"], 5, 5, n_boot=100)


@query()
def pooling_by_history(spark: SparkSession, d: str) -> DataFrame:
    return evaluations.pooling_by_history(i.days(spark, d), (7, 14), 4)


@query()
def corpus_benchmark(spark: SparkSession, d: str) -> DataFrame:
    days = i.days(spark, d)
    entries = days.select("series_id").distinct().withColumn("corpus", F.when(F.col("series_id") < "f", "national").otherwise("utility")).withColumn("country", F.lit("DE"))
    return evaluations.corpus_summary(evaluations.corpus_benchmark(days, entries, 5, 100))


@query(f"""WITH l AS (SELECT s_nationkey % 5 AS target, s_acctbal - 4500 AS lift FROM supplier), a AS (SELECT target, count(*) AS n,
  count(*) FILTER (lift > 0) AS wins, quantile_cont(lift, 0.25) AS p25, quantile_cont(lift, 0.5) AS median, quantile_cont(lift, 0.75) AS p75
  FROM l GROUP BY 1)
SELECT target, n, wins, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75,
  round((SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM range(3000) t(k) WHERE k >= wins
  AND k <= n), 6) AS p_value FROM a""")
def lift_summary(spark: SparkSession, d: str) -> DataFrame:
    x = i.table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("target"), (F.col("s_acctbal") - 4500).alias("lift"))
    return rounded(evaluations.lift_summary(x, ["target"]))


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS ts, sum(value) AS v FROM events
  GROUP BY 1, 2) SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(CASE WHEN count(v) >= 4 THEN sum(v) END, 6) AS value FROM h GROUP BY ts""")
def total_where(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.total_where(resample.hourly_sum(i.events(spark, d)), 4).withColumn("ts", i.stamp("ts")))
