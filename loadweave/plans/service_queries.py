"""Parts of one whole request on the driver tables: load, generation and residual load of the events as series of one plan.

The forecasts are the base alone (no ridge), so that SQL can say them; the parts on top are the request's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from . import inputs as i
from . import service
from .registry import query, rounded
from .support_queries import BASE_FIT

LIMIT, MOST, ENERGY = 60.0, 25.0, 120.0


def _request(spark: SparkSession, d: str, **parts) -> dict[str, DataFrame]:
    load = i.load(spark, d)
    made = load.withColumn("value", F.col("value") * 0.3 + F.hour("ts"))
    return service.run_forecast(load, "UTC", n_test=5, cal_days=7, lams=(), digits=None, generation=made, **parts)


def _dispatch(spark: SparkSession) -> dict:
    fee = spark.range(24).select(F.col("id").cast("int").alias("hour"), (F.col("id") * 7 % 24 / 100).alias("fee"))
    return {"energy_kwh": ENERGY, "p_max_kw": MOST, "fee": fee, "c_short": 0.2, "c_long": 0.1}


DAYS = i.DAYS.replace("days AS (", "days0 AS (")
BASED = i.BASED[len(i.DAYS) :]
RESIDUAL = f"""{DAYS}, days AS (SELECT series_id, day_idx, local_date, hour, value - (value * 0.3 + hour) AS value FROM days0){BASED}"""


@query(f"""WITH {RESIDUAL}, {BASE_FIT} SELECT d.series_id, CAST(local_date + 7 AS VARCHAR) AS local_date, d.hour, round(value, 8) AS p50,
  round(least(value, value + lo - c), 8) AS p10, round(greatest(value, value + hi + c), 8) AS p90
FROM days d JOIN e ON e.series_id = d.series_id AND d.day_idx = new - 7 JOIN rq ON rq.series_id = d.series_id AND rq.hour = d.hour JOIN cq
  ON cq.series_id = d.series_id""")
def service_residual_forecast(spark: SparkSession, d: str) -> DataFrame:
    x = _request(spark, d)["residual_forecast"]
    return rounded(x.withColumn("local_date", F.col("local_date").cast("string")), digits=8)


@query(f"""WITH {i.BASED}, e AS (SELECT series_id, max(day_idx) + 1 AS new FROM days GROUP BY 1),
x AS (SELECT series_id, value - snaive AS d FROM based JOIN e USING (series_id) WHERE day_idx >= new - 5)
SELECT series_id, round(sum(greatest(d, 0)), 6) AS more_model, round(sum(greatest(-d, 0)), 6) AS less_model, round(sum(d), 6) + 0.0 AS net_model,
  round(sum(abs(d)), 6) AS volume_model, 0.0::DOUBLE AS reduction_value FROM x GROUP BY 1""")
def service_surplus(spark: SparkSession, d: str) -> DataFrame:
    x = _request(spark, d, surplus_price=2.5)["surplus"]
    return rounded(x.select("series_id", "more_model", "less_model", "net_model", "volume_model", "reduction_value"))


@query(f"""WITH {i.BASED}, e AS (SELECT series_id, max(day_idx) + 1 AS new FROM days GROUP BY 1),
x AS (SELECT series_id, value - snaive AS d, day_idx >= new - 2 AS recent FROM based JOIN e USING (series_id) WHERE day_idx >= new - 5)
SELECT series_id, round(avg(d) FILTER (NOT recent), 6) AS bias_ref, round(avg(d) FILTER (recent), 6) AS bias_recent,
  round(avg(abs(d)) FILTER (NOT recent), 6) AS mae_ref, round(avg(abs(d)) FILTER (recent), 6) AS mae_recent FROM x GROUP BY 1""")
def service_drift(spark: SparkSession, d: str) -> DataFrame:
    """The last two days of the backtest against a reference of the three before."""
    return rounded(_request(spark, d, drift_days=2)["drift"].select("series_id", "bias_ref", "bias_recent", "mae_ref", "mae_recent"))


PLAN = f"""{RESIDUAL}, e AS (SELECT series_id, max(day_idx) + 1 AS new FROM days GROUP BY 1),
p AS (SELECT d.series_id, d.hour, value AS p50 FROM days d JOIN e ON e.series_id = d.series_id AND d.day_idx = new - 7),
r AS (SELECT b.series_id, hour, quantile_cont(value - snaive, 0.2 / (0.2 + 0.1)) AS q FROM based b JOIN e ON e.series_id = b.series_id WHERE day_idx >= new - 5 GROUP BY 1, 2),
b AS (SELECT p.series_id, p.hour, q, greatest(0, p50 - {MOST}) AS base_kw, (p.hour * 7 % 24) / 100 AS fee FROM p JOIN r ON r.series_id = p.series_id AND r.hour = p.hour),
c AS (SELECT *, greatest(0, least({MOST}, greatest(0, {LIMIT} - base_kw))) AS most FROM b),
k AS (SELECT *, greatest(0, least(most, {ENERGY} - coalesce(sum(most) OVER (PARTITION BY series_id ORDER BY fee, hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS kwh FROM c)"""


@query(f"""WITH {PLAN} SELECT series_id AS plan_id, hour, round(base_kw, 6) AS base_kw, round(kwh, 6) AS kwh, round(base_kw + kwh + q, 6) AS nomination_kw,
  base_kw + kwh <= {LIMIT} + 1e-9 AS grid_safe FROM k""")
def service_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Flexible energy under a limit on the residual load, and the nomination by hour."""
    x = _request(spark, d, threshold=LIMIT, dispatch=_dispatch(spark))["dispatch"]
    return rounded(x.select("plan_id", "hour", "base_kw", "kwh", "nomination_kw", "grid_safe"))


@query(f"""WITH {PLAN} SELECT series_id AS ledger_id, count(*) AS n_entries, NULL::BIGINT AS first_broken, true AS chain_ok FROM k
  WHERE kwh > 1e-9 GROUP BY 1""")
def service_audit(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of what the dispatch does, hour by hour."""
    return ledger.verify(_request(spark, d, threshold=LIMIT, dispatch=_dispatch(spark), audit=True)["audit"])


@query(f"""WITH {DAYS}, days AS (SELECT * FROM days0), e AS (SELECT series_id, max(day_idx) + 1 AS new FROM days GROUP BY 1),
i AS (SELECT d.series_id, d.local_date + 7 AS day, d.hour, d.value AS p50 FROM days d)
SELECT d.series_id, CAST(d.local_date AS VARCHAR) AS target_date, count(*) AS n, round(avg(abs(d.value - p50)), 6) AS mae, round(avg(d.value - p50), 6) + 0.0 AS bias,
  round(100 * avg(CASE WHEN d.value BETWEEN p50 - 10 AND p50 + 10 THEN 1.0 ELSE 0 END), 6) AS coverage
FROM days d JOIN i ON i.series_id = d.series_id AND i.day = d.local_date AND i.hour = d.hour GROUP BY 1, 2""")
def service_track_record(spark: SparkSession, d: str) -> DataFrame:
    """Stored forecasts (last week's values, issued twice, the first time wrongly) against what came."""
    x = i.days(spark, d).groupBy("series_id", "local_date").agg(F.array_sort(F.collect_list(F.struct("hour", "value"))).alias("s"))
    x = x.select("series_id", F.date_add("local_date", 7).cast("string").alias("target_date"), F.col("s.value").alias("v"), F.explode(F.array(F.lit("2024-01-01T00:00"), F.lit("2024-01-02T00:00"))).alias("issued_utc"))
    shift = F.when(F.col("issued_utc") == "2024-01-01T00:00", 1000.0).otherwise(0.0)
    issued = x.select("series_id", "target_date", "issued_utc", *(F.transform("v", lambda v: v + shift + k).alias(c) for c, k in (("p10", -10.0), ("p50", 0.0), ("p90", 10.0))))  # noqa: B023
    return rounded(_request(spark, d, issued=issued)["track_record"])
