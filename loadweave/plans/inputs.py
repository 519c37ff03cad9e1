"""Series, devices and settlement rows taken from the driver tables, for queries and benchmarks.

SQL twins of each input are common table expressions with the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, resample


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(c: str):
    """A time as text, so that results compare without time-zone types."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "user_id")


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums per event type on whole days, empty hours 0."""
    return resample.whole_days(resample.hourly_sum(events(spark, sf_dir)), 0.0)


LOAD = """
hsum AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY 1, 2),
bounds AS (SELECT series_id, date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) + INTERVAL 23 HOUR AS hi FROM hsum GROUP BY 1),
axis AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM bounds),
load AS (SELECT a.series_id, a.ts, coalesce(h.value, 0.0) AS value FROM axis a LEFT JOIN hsum h ON a.series_id = h.series_id AND a.ts = h.ts)"""


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.daily_matrix(load(spark, sf_dir))


DAYS = (
    LOAD
    + """,
days AS (SELECT series_id, CAST(dense_rank() OVER (PARTITION BY series_id ORDER BY CAST(ts AS DATE)) - 1 AS INT) AS day_idx,
  CAST(ts AS DATE) AS local_date, CAST(hour(ts) AS INT) AS hour, value FROM load)"""
)


def based(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.baselines(days(spark, sf_dir))


BASED = (
    DAYS
    + """,
based AS (SELECT *, lag(value, 1) OVER w AS persist, lag(value, 7) OVER w AS snaive FROM days WINDOW w AS (PARTITION BY series_id,
  hour ORDER BY day_idx))"""
)


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast rows around the seasonal-naive value, as a model's bands would come."""
    x = based(spark, sf_dir).where("snaive is not null")
    return x.select(
        "series_id", F.col("day_idx").alias("day"), "hour", F.col("value").alias("actual"), (F.col("snaive") * 0.6).alias("p10"),
        F.col("snaive").alias("p50"), (F.col("snaive") * 1.5 + 10).alias("p90"), "persist"
    )


BANDS = (
    BASED
    + """,
bands AS (SELECT series_id, day_idx AS day, hour, value AS actual, snaive * 0.6 AS p10, snaive AS p50, snaive * 1.5 + 10 AS p90, persist
  FROM based WHERE snaive IS NOT NULL)"""
)


def settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as settlement rows: quantity against a schedule, prices as imbalance and spot price."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_returnflag").alias("grp"),
        F.col("l_orderkey").alias("k"),
        F.to_date("l_shipdate").alias("day"),
        F.col("l_quantity").alias("actual"),
        (F.col("l_quantity") * (0.95 + F.col("l_discount"))).alias("sched_a"),
        (F.col("l_quantity") * (0.98 + F.col("l_tax") / 2)).alias("sched_b"),
        (F.col("l_extendedprice") / 1000).alias("rebap"),
        (F.col("l_tax") * 500 + 10).alias("spot"),
        (F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp")).alias("recent"),
    )


SETTLEMENT = """
settlement AS (SELECT l_returnflag AS grp, l_orderkey AS k, CAST(l_shipdate AS DATE) AS day, l_quantity AS actual,
  l_quantity * (0.95 + l_discount) AS sched_a,
  l_quantity * (0.98 + l_tax / 2) AS sched_b, l_extendedprice / 1000 AS rebap, l_tax * 500 + 10 AS spot,
  l_shipdate >= TIMESTAMP '1998-06-01' AS recent FROM lineitem)"""


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as controllable devices of a nation's feeder, half of its demand as cap. Hundredths are rounded as doubles, like the
    SQL's: round(x, 2) goes by the shortest decimal text, which differs where x * 100 is just below a half."""
    from pyspark.sql import Window as W

    x = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("feeder_id"),
        F.col("c_custkey").alias("device_id"),
        (F.round((F.col("c_acctbal") + 1000) / 500 * 100) / 100).alias("demand_kw"),
        F.lit(1.5).alias("floor_kw"),
        (1.0 + F.col("c_custkey") % 3).cast("double").alias("weight"),
    )
    return x.withColumn("cap_kw", F.round(F.sum("demand_kw").over(W.partitionBy("feeder_id")) * 0.6 * 100) / 100)


DEVICES = """
dev0 AS (SELECT c_nationkey AS feeder_id, c_custkey AS device_id, round((c_acctbal + 1000) / 500, 2) AS demand_kw, 1.5 AS floor_kw,
  CAST(1.0 + c_custkey % 3 AS DOUBLE) AS weight FROM customer),
devices AS (SELECT *, round(sum(demand_kw) OVER (PARTITION BY feeder_id) * 0.6, 2) AS cap_kw FROM dev0)"""


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type and hour: the mean as point forecast, deviations of the days as residuals."""
    x = days(spark, sf_dir).groupBy("series_id", "hour").agg(F.avg("value").alias("point_kw"), F.array_sort(F.collect_list(F.struct("day_idx", "value"))).alias("v"))
    x = x.withColumn("residuals", F.transform("v", lambda s: s["value"] - F.col("point_kw"))).drop("v")
    return x.select(
        F.col("series_id").alias("asset_id"), "hour", "point_kw", "residuals", (F.col("point_kw") * 0 + 300.0).alias("rating_kw"),
        (F.lit(15.0) + F.col("hour") / 2).alias("ambient_c")
    )


SCENARIOS = (
    DAYS
    + """,
pts AS (SELECT series_id, hour, avg(value) AS point_kw FROM days GROUP BY 1, 2),
scen AS (SELECT d.series_id AS asset_id, d.hour, d.day_idx, p.point_kw,
  d.value - p.point_kw AS r, 300.0 AS rating_kw, 15.0 + d.hour / 2.0 AS ambient_c
  FROM days d JOIN pts p ON d.series_id = p.series_id AND d.hour = p.hour)"""
)
