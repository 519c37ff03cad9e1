"""Settlement, drift, allocation, risk, ledger and model queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import backtests, boosting, bootstrap, calibration, control, features, ledger, metrics, models, reconcile, relations, risk, studies
from . import inputs as i
from .registry import query, rounded, stirred


# --- settlement ---------------------------------------------------------------------------------
@query(f"""WITH {i.SETTLEMENT}, x AS (SELECT grp, actual - sched_a AS e, rebap - spot AS s FROM settlement)
SELECT grp, count(*) AS n, round(sum(e * s), 4) AS total, round(count(*) * avg(e) * avg(s), 4) AS bias_part, round(count(*) * covar_pop(e,
  s), 4) AS correlation_part, round(sum(abs(e)), 4) AS volume FROM x GROUP BY 1""")
def imbalance_premium(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.imbalance_premium(i.settlement(spark, d), ["grp"], "sched_a", "actual", "rebap", "spot"), digits=4)


@query(f"WITH {i.SETTLEMENT} SELECT grp, count(*) AS n, round(sum((sched_b - sched_a) * (rebap - spot)), 4) AS saving FROM settlement GROUP BY 1")
def forecast_saving(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.forecast_saving(i.settlement(spark, d), ["grp"], "sched_a", "sched_b", "rebap", "spot"), digits=4)


@query(f"""WITH {i.SETTLEMENT}, x AS (SELECT grp, (actual - sched_a) * 0.25 AS d, rebap FROM settlement)
SELECT grp, round(sum(greatest(d, 0)), 4) AS more, round(sum(greatest(-d, 0)), 4) AS less, round(sum(d), 4) AS net, round(sum(abs(d)), 4) AS volume,
  round(sum(abs(d) * rebap), 4) AS cost FROM x GROUP BY 1""")
def surplus_deficit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.surplus_deficit(i.settlement(spark, d), ["grp"], "sched_a", "actual", "rebap", 0.25), digits=4)


@query(f"""WITH {i.SETTLEMENT}, x AS (SELECT grp, rebap - spot AS v FROM settlement), s AS (SELECT grp, count(*) AS n, avg(abs(v)) AS mean,
  quantile_cont(abs(v), 0.5) AS median, quantile_cont(abs(v), 0.25) AS p25,
  quantile_cont(abs(v), 0.75) AS p75, quantile_cont(abs(v), 0.95) AS p95, avg(v) AS signed_mean FROM x GROUP BY 1)
SELECT grp, n, round(mean, 6) AS mean, round(median, 8) AS median, round(p25, 8) AS p25, round(p75, 8) AS p75, round(p95, 8) AS p95,
  round(signed_mean, 6) AS signed_mean,
  round(median * 876, 7) AS saving_median, round(p25 * 876, 7) AS saving_p25, round(p75 * 876, 7) AS saving_p75,
  round(abs(signed_mean) * 876, 4) AS saving_expected FROM s""")
def spread_stats(spark: SparkSession, d: str) -> DataFrame:
    x = i.settlement(spark, d).withColumn("v", F.col("rebap") - F.col("spot"))
    out = metrics.saving_estimates(metrics.spread_stats(x, ["grp"], "v"), 0.1)
    # prices have five decimals and quantiles a twentieth of a step more: rounded where no value lies half-way
    out = rounded(rounded(out, "median", "p25", "p75", "p95", digits=8), "saving_median", "saving_p25", "saving_p75", digits=7)
    return rounded(rounded(out, "mean", "signed_mean"), "saving_expected", digits=4)


@query(f"""WITH {i.SETTLEMENT}, x AS (SELECT grp, count(DISTINCT day) AS n_days, sum((actual - sched_a) * (rebap - spot)) AS a,
  sum((actual - sched_b) * (rebap - spot)) AS b FROM settlement GROUP BY 1)
SELECT grp, n_days, round(a, 4) AS premium_baseline, round(b, 4) AS premium_model, round(a - b, 4) AS saving,
  round((a - b) * 365 / n_days, 4) AS saving_year FROM x""")
def realized_settlement(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.realized_settlement(i.settlement(spark, d), ["grp"], "sched_a", "sched_b", "actual", "rebap", "spot", "day"), digits=4)


@query(f"""WITH {i.SETTLEMENT}, x AS (SELECT grp, (actual - sched_a) * (rebap - spot) AS c FROM settlement), v AS (SELECT grp,
  quantile_cont(c, 0.95) AS q FROM x GROUP BY 1)
SELECT grp, round(any_value(q), 5) AS var, round(any_value(q) + avg(greatest(c - q, 0)) / 0.05, 5) AS cvar FROM x JOIN v USING (grp) GROUP BY 1""")
def cvar(spark: SparkSession, d: str) -> DataFrame:
    x = i.settlement(spark, d).withColumn("c", (F.col("actual") - F.col("sched_a")) * (F.col("rebap") - F.col("spot")))
    return rounded(metrics.cvar(x, ["grp"], "c"), digits=5)


@query("""WITH r AS (SELECT p_size % 5 AS grp, p_retailprice AS rebap, p_partkey FROM part), s AS (SELECT s_acctbal AS spot, s_suppkey FROM supplier)
SELECT strftime(TIMESTAMP '2024-01-01' + INTERVAL (k // 4) HOUR, '%Y-%m-%d %H:%M:%S') AS ts, round(avg(rebap), 6) AS rebap,
  round(avg(spot), 6) AS spot FROM
(SELECT p_partkey AS k, rebap, spot FROM r JOIN s ON p_partkey = s_suppkey) GROUP BY 1""")
def price_pairs(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col(c).cast("int") * 15)).alias("ts")
    a = i.table(spark, d, "part").select(at("p_partkey"), F.col("p_retailprice").alias("price"))
    b = i.table(spark, d, "supplier").select(at("s_suppkey"), F.col("s_acctbal").alias("price"))
    return rounded(relations.price_pairs(a, b).withColumn("ts", i.stamp("ts")))


# --- drift --------------------------------------------------------------------------------------
DRIFT = f"""{i.SETTLEMENT}, er AS (SELECT grp, recent, actual - sched_a AS error FROM settlement), both_ AS (SELECT grp FROM er GROUP BY 1),
edges AS (SELECT grp, quantile_cont(error, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e, count(*) AS n FROM er WHERE NOT recent GROUP BY 1
  HAVING count(*) >= 10),
bins AS (SELECT grp, len(list_filter(e, lambda x: x < error)) AS bin, count(*) FILTER (NOT recent) AS r, count(*) FILTER (recent) AS c FROM er
  JOIN edges USING (grp) GROUP BY 1, 2),
sh AS (SELECT grp, greatest(1e-4, r / sum(r) OVER (PARTITION BY grp)) AS pr, greatest(1e-4,
  coalesce(c / nullif(sum(c) OVER (PARTITION BY grp), 0), 1e-4)) AS pc FROM bins),
psi AS (SELECT grp, sum((pc - pr) * ln(pc / pr)) AS psi FROM sh GROUP BY 1),
vals AS (SELECT grp, error, count(*) FILTER (NOT recent) AS r, count(*) FILTER (recent) AS c FROM er GROUP BY 1, 2),
cdf AS (SELECT grp, abs(sum(r) OVER w / nullif(sum(r) OVER g, 0) - sum(c) OVER w / nullif(sum(c) OVER g, 0)) AS dd, sum(r) OVER g AS nr,
  sum(c) OVER g AS nc FROM vals
  WINDOW w AS (PARTITION BY grp ORDER BY error), g AS (PARTITION BY grp)),
ks AS (SELECT grp, max(dd) AS ks, 1.358 * sqrt((any_value(nr) + any_value(nc)) / (any_value(nr) * any_value(nc))) AS kc FROM cdf GROUP BY 1),
base AS (SELECT grp, avg(error) FILTER (NOT recent) AS b0, avg(error) FILTER (recent) AS b1, stddev_pop(error) FILTER (NOT recent) AS s0,
  avg(abs(error)) FILTER (NOT recent) AS m0, avg(abs(error)) FILTER (recent) AS m1 FROM er GROUP BY 1)"""


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return i.settlement(spark, d).withColumn("error", F.col("actual") - F.col("sched_a"))


@query(f"WITH {DRIFT} SELECT grp, round(psi, 6) AS psi FROM psi")
def psi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.psi(_errors(spark, d), ["grp"]))


@query(f"WITH {DRIFT} SELECT grp, round(ks, 6) AS ks, round(kc, 6) AS ks_critical FROM ks WHERE ks IS NOT NULL")
def ks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ks(_errors(spark, d), ["grp"]).where("ks is not null"))


@query(f"""WITH {DRIFT}, x AS (SELECT *, abs(b1 - b0) / s0 AS bs, m1 / m0 AS mr FROM base JOIN psi USING (grp) JOIN ks USING (grp)
  WHERE b1 IS NOT NULL),
l AS (SELECT *, greatest(CASE WHEN bs >= 0.5 THEN 2 WHEN bs >= 0.25 THEN 1 ELSE 0 END, CASE WHEN mr >= 1.3 THEN 2 WHEN mr >= 1.15 THEN 1 ELSE 0 END,
  CASE WHEN psi >= 0.25 THEN 2 WHEN psi >= 0.1 THEN 1 ELSE 0 END, CASE WHEN ks > kc THEN 1 ELSE 0 END) AS level FROM x)
SELECT grp, round(bs, 6) AS bias_shift_std, round(mr, 6) AS mae_ratio, round(psi, 6) AS psi, round(ks, 6) AS ks,
  level, ['stable', 'watch', 'drift'][level + 1] AS status FROM l""")
def drift_status(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.drift_report(_errors(spark, d), ["grp"]).where("bias_recent is not null")
    return rounded(x.select("grp", "bias_shift_std", "mae_ratio", "psi", "ks", "level", "status"))


@query(f"""WITH {i.BANDS}, c AS (SELECT series_id, count(*) AS n, avg(CASE WHEN actual BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END) AS coverage,
  avg(CASE WHEN actual < p10 THEN 1.0 ELSE 0.0 END) AS below,
  avg(CASE WHEN actual > p90 THEN 1.0 ELSE 0.0 END) AS above FROM bands GROUP BY 1) SELECT series_id, n, round(coverage, 6) AS coverage,
  round(below, 6) AS below, round(above, 6) AS above, abs(coverage - 0.8) > 0.1 AS drift FROM c""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.coverage_report(i.bands(spark, d), ["series_id"]))


@query(f"""WITH {i.BASED}, m AS (SELECT series_id, day_idx, avg(value - snaive) AS v FROM based WHERE snaive IS NOT NULL GROUP BY 1, 2),
  l AS (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY day_idx) AS b FROM m)
SELECT series_id, count(*) AS n, round(corr(b, v), 6) AS r1 FROM l WHERE b IS NOT NULL GROUP BY 1""")
def lag1_autocorr(spark: SparkSession, d: str) -> DataFrame:
    m = i.based(spark, d).where("snaive is not null").groupBy("series_id", "day_idx").agg(F.avg("target").alias("v"))
    return rounded(metrics.lag1_correlation(m, ["series_id"], "v"))


@query("""WITH x AS (SELECT c_nationkey, greatest(c_acctbal, 0) AS v,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY greatest(c_acctbal, 0)) AS i FROM customer)
SELECT c_nationkey, count(*) AS n, round(CASE WHEN sum(v) > 0 THEN 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1.0) / count(*)
  ELSE 0 END, 6) AS gini FROM x GROUP BY 1""")
def gini(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.gini(i.table(spark, d, "customer"), ["c_nationkey"], "c_acctbal"))


@query("""WITH m AS (SELECT l_returnflag AS grp, count(*) AS n, avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT grp, any_value(n) AS n, round(any_value(s), 4) AS std, round(avg(pow((l_extendedprice - mu) / s, 3)), 6) AS skew,
  round(avg(pow((l_extendedprice - mu) / s, 4)) - 3, 6) AS kurtosis FROM lineitem JOIN m ON l_returnflag = grp GROUP BY 1""")
def error_moments(spark: SparkSession, d: str) -> DataFrame:
    x = metrics.moments(i.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "grp"), ["grp"], "l_extendedprice")
    return rounded(rounded(x, "skew", "kurtosis"), "std", digits=4)


@query(f"""WITH {i.BASED}, a AS (SELECT series_id, day_idx, avg(abs(persist - value)) < avg(abs(snaive - value)) AS won FROM based
  WHERE snaive IS NOT NULL GROUP BY 1, 2), w AS (SELECT series_id, count(*) FILTER (won) AS wins, count(*) AS n FROM a GROUP BY 1)
SELECT series_id, wins, n, round((SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM range(100) t(k)
  WHERE k >= wins AND k <= n), 6) AS p_value FROM w""")
def sign_test(spark: SparkSession, d: str) -> DataFrame:
    x = i.based(spark, d).where("snaive is not null").groupBy("series_id", "day_idx").agg(
        (F.avg(F.abs(F.col("persist") - F.col("value"))) < F.avg(F.abs(F.col("snaive") - F.col("value")))).alias("won")
    )
    w = x.groupBy("series_id").agg(F.count_if("won").alias("wins"), F.count("*").alias("n"))
    return rounded(metrics.sign_test(w, "wins", "n"))


# --- allocation ---------------------------------------------------------------------------------
LEVEL = f"""{i.DEVICES}, s AS (SELECT *, sum(demand_kw) OVER g AS total, count(*) OVER g AS n, row_number() OVER o AS k,
  coalesce(sum(demand_kw) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM devices
  WINDOW g AS (PARTITION BY feeder_id), o AS (PARTITION BY feeder_id ORDER BY demand_kw, device_id)),
c AS (SELECT *, (cap_kw - pre) / (n - k + 1) AS cand FROM s), lv AS (SELECT feeder_id, arg_min(cand, k) AS level FROM c
  WHERE cand <= demand_kw + 1e-12 GROUP BY 1)"""


@query(f"""WITH {LEVEL} SELECT c.feeder_id, device_id, round(CASE WHEN total <= cap_kw THEN demand_kw WHEN cap_kw < n * 1.5 THEN 1.5
  ELSE least(demand_kw, greatest(level, 1.5)) END, 8) AS limit_kw, cap_kw >= n * 1.5 AS feasible
FROM c LEFT JOIN lv ON c.feeder_id = lv.feeder_id""")
def water_fill(spark: SparkSession, d: str) -> DataFrame:
    x = control.water_fill(i.devices(spark, d), ["feeder_id"], 1.5, digits=None)
    return rounded(x.select("feeder_id", "device_id", "limit_kw", "feasible"), digits=8)


WEIGHTED = f"""{i.DEVICES}, f AS (SELECT *, least(floor_kw, demand_kw) AS fl FROM devices), b AS (SELECT *, (demand_kw - fl) / weight AS b FROM f),
s AS (SELECT *, sum(demand_kw) OVER g AS total, sum(fl) OVER g AS floors, row_number() OVER o AS k,
  (sum(demand_kw) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  + coalesce(sum(fl) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - cap_kw) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW
  AND UNBOUNDED FOLLOWING) AS cand FROM b
  WINDOW g AS (PARTITION BY feeder_id), o AS (PARTITION BY feeder_id ORDER BY b, device_id)),
pr AS (SELECT feeder_id, arg_min(cand, k) AS x FROM s WHERE cand <= b + 1e-12 GROUP BY 1),
wf AS (SELECT s.*, CASE WHEN total <= cap_kw THEN demand_kw WHEN cap_kw < floors THEN fl ELSE greatest(fl, least(demand_kw,
  demand_kw - weight * x)) END AS lim FROM s LEFT JOIN pr ON s.feeder_id = pr.feeder_id)"""


@query(f"WITH {WEIGHTED} SELECT feeder_id, device_id, round(lim, 8) AS limit_kw, cap_kw >= floors AS feasible FROM wf")
def water_fill_weighted(spark: SparkSession, d: str) -> DataFrame:
    x = control.weighted_fill(i.devices(spark, d), ["feeder_id"], digits=None)
    return rounded(x.select("feeder_id", "device_id", "limit_kw", "feasible"), digits=8)


@query(f"""WITH {WEIGHTED} SELECT feeder_id AS pool_id, device_id, round(lim, 8) AS energy_kwh, round(demand_kw - lim, 8) + 0.0 AS shed_kwh,
  cap_kw >= floors AS safe FROM wf""")
def pool_dispatch(spark: SparkSession, d: str) -> DataFrame:
    x = i.devices(spark, d).withColumnRenamed("feeder_id", "pool_id")
    periods = x.select("pool_id", "cap_kw").distinct().select("pool_id", "cap_kw", F.explode(F.array(F.lit(0), F.lit(1))).alias("hour"))
    return rounded(control.pool_dispatch(x.drop("cap_kw"), periods, 0.5, digits=None), digits=8)


RD = """dv AS (SELECT o_orderpriority AS feeder_id, o_orderkey AS device_id, 5.0 + o_custkey % 7 AS demand_kw FROM orders),
dm AS (SELECT feeder_id, sum(demand_kw) AS demand, count(*) AS n, sum(greatest(demand_kw - 4.2, 0)) AS naive FROM dv GROUP BY 1),
hr AS (SELECT feeder_id, h AS hour, demand * (0.8 + h / 40.0) + 100 AS fc FROM dm, range(24) t(h)),
x AS (SELECT hr.*, demand, n, naive, fc > th AS congested, greatest(0, th - (fc - demand)) AS cap FROM hr JOIN dm USING (feeder_id),
  (SELECT avg(demand) + 100 AS th FROM dm))"""


def _redispatch_plan(spark: SparkSession, d: str) -> DataFrame:
    o = i.table(spark, d, "orders")
    dv = o.select(F.col("o_orderpriority").alias("feeder_id"), F.col("o_orderkey").alias("device_id"), (5.0 + F.col("o_custkey") % 7).alias("demand_kw"))
    dm = dv.groupBy("feeder_id").agg(F.sum("demand_kw").alias("demand"))
    hours = dm.select("feeder_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"), "demand").withColumn("forecast_kw", F.col("demand") * (0.8 + F.col("hour") / 40.0) + 100)
    threshold = dm.agg(F.avg("demand")).first()[0] + 100
    return control.redispatch(hours.select("feeder_id", "hour", "forecast_kw"), dv, threshold, digits=None)


@query(f"""WITH {RD} SELECT feeder_id, CAST(hour AS INT) AS hour, congested, round(CASE WHEN congested THEN naive ELSE 0 END, 4) AS naive_shed_kw,
  round(fc, 4) AS forecast_kw,
  CASE WHEN congested THEN cap >= n * 4.2 ELSE true END AS feasible, round(CASE WHEN NOT congested THEN 0 WHEN cap < n * 4.2
  THEN demand - n * 4.2 ELSE demand - cap END, 6) + 0.0 AS shed_kw FROM x""")
def redispatch(spark: SparkSession, d: str) -> DataFrame:
    x = _redispatch_plan(spark, d).select("feeder_id", "hour", "congested", "naive_shed_kw", "forecast_kw", "feasible", "shed_kw")
    return rounded(rounded(x, "naive_shed_kw", "forecast_kw", digits=4), "shed_kw")


TARIFF = """tf AS (SELECT p_brand AS plan, p_partkey AS hour, round(p_retailprice / 10000, 3) AS fee, 5.0 AS p_max_kw, 3.0 + p_size % 4 AS cap_kw,
  p_size % 5 <> 0 AS ok, 40.0 AS energy_kwh FROM part),
ce AS (SELECT *, CASE WHEN ok THEN least(p_max_kw, cap_kw) ELSE 0 END AS ceil_ FROM tf),
pl AS (SELECT *, greatest(0, least(ceil_, energy_kwh - coalesce(sum(ceil_) OVER (PARTITION BY plan ORDER BY fee,
  hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS kwh,
  greatest(0, least(ceil_, energy_kwh - coalesce(sum(ceil_) OVER (PARTITION BY plan ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0))) AS naive_kwh FROM ce)"""


@query(f"""WITH {TARIFF}, s AS (SELECT plan, sum(kwh) AS a, sum(kwh * fee) AS c, sum(naive_kwh * fee) AS nc FROM pl GROUP BY 1)
SELECT plan, round(a, 6)::DOUBLE AS placed_kwh, round(c, 6)::DOUBLE AS cost, round(nc, 6)::DOUBLE AS naive_cost,
  round(40.0 - a, 6)::DOUBLE + 0.0 AS shortfall_kwh, round(nc - c, 6)::DOUBLE + 0.0 AS saving FROM s""")
def greedy_tariff(spark: SparkSession, d: str) -> DataFrame:
    x = i.table(spark, d, "part").select(
        F.col("p_brand").alias("plan"),
        F.col("p_partkey").alias("hour"),
        F.round(F.col("p_retailprice") / 10000, 3).alias("fee"),
        F.lit(5.0).alias("p_max_kw"),
        (3.0 + F.col("p_size") % 4).alias("cap_kw"),
        (F.col("p_size") % 5 != 0).alias("available"),
        F.lit(40.0).alias("energy_kwh"),
    )
    return rounded(control.tariff_summary(control.tariff_placement(x, ["plan"]), ["plan"]))


@query("""WITH s AS (SELECT l_orderkey AS malo, min(l_shipdate) AS a, max(l_shipdate) + INTERVAL 6 HOUR AS b, min(l_quantity) + 4.2 AS p
  FROM lineitem GROUP BY 1),
p2 AS (SELECT malo, a, a + INTERVAL 30 HOUR AS b, p + 10 AS lim FROM s UNION ALL SELECT malo, a + INTERVAL 5 HOUR, a + INTERVAL 12 HOUR, p FROM s),
r AS (SELECT malo, a + INTERVAL (h) HOUR AS ts FROM s, range(0, 36, 4) t(h))
SELECT r.malo, strftime(r.ts, '%Y-%m-%d %H:%M:%S') AS ts, min(lim) FILTER (r.ts >= p2.a AND r.ts < p2.b) AS active_limit_kw FROM r JOIN p2
  ON r.malo = p2.malo GROUP BY ALL""")
def active_setpoints(spark: SparkSession, d: str) -> DataFrame:
    s = i.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("malo")).agg(F.min("l_shipdate").cast("timestamp").alias("a"), (F.min("l_quantity") + 4.2).alias("p"))
    h = lambda n: F.col("a") + F.make_dt_interval(hours=n if not isinstance(n, int) else F.lit(n))
    points = s.select("malo", h(0).alias("start_ts"), h(30).alias("end_ts"), (F.col("p") + 10).alias("p_limit_kw")).union(s.select("malo", h(5), h(12), "p"))
    readings = s.select("malo", "a", F.explode(F.sequence(F.lit(0), F.lit(32), F.lit(4))).alias("k")).select("malo", h(F.col("k")).alias("ts"))
    x = control.active_limit(readings, points)
    return x.withColumn("ts", i.stamp("ts"))


# --- risk ---------------------------------------------------------------------------------------
@query(f"WITH {i.SCENARIOS} SELECT asset_id, hour, round(any_value(point_kw) + quantile_cont(r, 0.6), 6) AS nomination_kw FROM scen GROUP BY 1, 2")
def newsvendor(spark: SparkSession, d: str) -> DataFrame:
    x = i.scenarios(spark, d)
    return rounded(x.select("asset_id", "hour", risk.nomination(F.col("point_kw"), F.col("residuals"), 3.0, 2.0).alias("nomination_kw")))


@query(f"""WITH {i.SCENARIOS}, v AS (SELECT asset_id, hour, rating_kw, round(point_kw + r, 6) AS l FROM scen) SELECT asset_id, hour,
  round(avg(CASE WHEN l > rating_kw THEN 1.0 ELSE 0.0 END), 6) AS p_overload, round(avg(greatest(l - rating_kw, 0)), 6) AS expected_excess_kwh,
  round(quantile_cont(l, 0.5), 5) AS p50_kw, round(quantile_cont(l, 0.9), 5) AS p90_kw, avg(CASE WHEN l > rating_kw THEN 1.0
  ELSE 0.0 END) > 0.05 AS at_risk FROM v GROUP BY 1, 2""")
def overload_probability(spark: SparkSession, d: str) -> DataFrame:
    x = risk.overload(i.scenarios(spark, d)).select("asset_id", "hour", "p_overload", "expected_excess_kwh", "p50_kw", "p90_kw", "at_risk")
    return rounded(rounded(x, "p_overload", "expected_excess_kwh"), "p50_kw", "p90_kw", digits=5)


@query(f"""WITH {i.SCENARIOS}, k AS (SELECT asset_id, hour, point_kw, rating_kw, r, row_number() OVER (PARTITION BY asset_id,
  hour ORDER BY r DESC) AS i, count(*) OVER (PARTITION BY asset_id, hour) AS n FROM scen)
SELECT asset_id, round(greatest(0, least(min(rating_kw - point_kw - r), any_value(rating_kw))), 5) AS hosting_kw FROM k
  WHERE i = floor(0.05 * n + 1e-12) + 1 GROUP BY 1""")
def hosting_capacity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.hosting_capacity(i.scenarios(spark, d)), digits=5)


def _fleets(spark: SparkSession) -> DataFrame:
    return spark.sql("select 'ev' fleet, 1.0D sign, 50.0D units, 4.0D rated_kw, 0.8D coincidence, transform(sequence(0, 23), h -> if(h >= 18, 1.0D, 0.25D)) profile union all select 'pv', -1.0D, 10.0D, 8.0D, 1.0D, transform(sequence(0, 23), h -> if(h between 8 and 16, 0.5D, 0.0D))")


@query(f"""WITH {i.SCENARIOS}, f AS (SELECT unnest([0.5, 1.0, 1.5]) AS factor UNION ALL SELECT 0.0), v AS (SELECT asset_id, hour, factor,
  round(point_kw + r, 6) + CASE WHEN factor = 0 THEN 0 ELSE
  200.0 * least(1, 0.8 * factor) * (CASE WHEN hour >= 18 THEN 1 ELSE 0.25 END) - 80.0 * least(1, factor) * (CASE WHEN hour BETWEEN 8 AND 16
  THEN 0.5 ELSE 0 END) END AS l FROM scen, f),
h AS (SELECT asset_id, factor, hour, avg(CASE WHEN l > 300 THEN 1.0 ELSE 0.0 END) AS p, avg(greatest(l - 300, 0)) AS x FROM v GROUP BY 1, 2, 3)
SELECT asset_id, factor::DOUBLE AS factor, round(1 - product(1 - p), 6) + 0.0 AS p_any, round(sum(x), 4) AS excess_kwh,
  count(*) FILTER (p > 0.05) AS hours_at_risk FROM h GROUP BY 1, 2""")
def scenario_band(spark: SparkSession, d: str) -> DataFrame:
    x = risk.coincidence_band(i.scenarios(spark, d), _fleets(spark)).select("asset_id", "factor", "p_any", "excess_kwh", "hours_at_risk")
    return rounded(rounded(x, "p_any"), "excess_kwh", digits=4)


@query(f"""WITH RECURSIVE {i.SCENARIOS}, p AS (SELECT DISTINCT asset_id, hour, point_kw / 200.0 AS k, ambient_c AS a FROM scen),
  u AS (SELECT *, 55 * pow((k * k * 5 + 1) / 6, 0.8) AS ou, 23 * pow(k, 1.6) AS wu FROM p),
t AS (SELECT asset_id, hour, ou AS o, wu AS w, a FROM u WHERE hour = 0 UNION ALL SELECT u.asset_id, u.hour,
  t.o + (u.ou - t.o) * (1 - exp(-1.0 / 3)), t.w + (u.wu - t.w) * (1 - exp(-1.0 / 0.25)), u.a FROM t JOIN u ON u.asset_id = t.asset_id
  AND u.hour = t.hour + 1)
SELECT asset_id, round(max(a + o + w), 5) AS peak_c, round(sum(pow(2, (a + o + w - 98) / 6)), 6) AS loss_h FROM t GROUP BY 1""")
def thermal_path(spark: SparkSession, d: str) -> DataFrame:
    x = i.scenarios(spark, d).groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("hour", "point_kw", "ambient_c"))).alias("h"))
    x = x.select("asset_id", F.col("h.point_kw").alias("load_kw"), F.col("h.ambient_c").alias("ambient_c"), F.lit(200.0).alias("rating_kw"))
    out = risk.thermal_path(x).select("asset_id", "peak_c", "loss_h")
    return rounded(rounded(out, "loss_h"), "peak_c", digits=5)


@query(f"""WITH RECURSIVE {i.SCENARIOS}, p AS (SELECT asset_id, day_idx AS scenario, hour, greatest(0, (point_kw + r) / rating_kw) AS k,
  ambient_c AS a FROM scen), u AS (SELECT *, 55 * pow((k * k * 5 + 1) / 6, 0.8) AS ou, 23 * pow(k, 1.6) AS wu FROM p),
t AS (SELECT asset_id, scenario, hour, ou AS o, wu AS w, a FROM u WHERE hour = 0 UNION ALL
  SELECT u.asset_id, u.scenario, u.hour, t.o + (u.ou - t.o) * (1 - exp(-1.0 / 3)), t.w + (u.wu - t.w) * (1 - exp(-1.0 / 0.25)), u.a FROM t JOIN u
  ON u.asset_id = t.asset_id AND u.scenario = t.scenario AND u.hour = t.hour + 1),
x AS (SELECT asset_id, scenario, max(a + o + w) AS peak, sum(pow(2, (a + o + w - 98) / 6)) AS loss FROM t GROUP BY 1, 2)
SELECT asset_id, count(*) AS scenarios, round(avg(CASE WHEN peak > 120 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS p_exceed,
  round(quantile_cont(peak, 0.5), 5) AS peak_p50, round(quantile_cont(peak, 0.9), 5) AS peak_p90, round(avg(loss), 5) AS loss_h,
  avg(CASE WHEN peak > 120 THEN 1.0 ELSE 0.0 END) > 0.05 AS at_risk FROM x GROUP BY 1""")
def thermal_risk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(risk.thermal_risk(i.scenarios(spark, d)), "p_exceed"), "peak_p50", "peak_p90", "loss_h", digits=5)


@query(f"""WITH {i.SCENARIOS}, v AS (SELECT asset_id, hour, point_kw + r AS a FROM scen), b AS (SELECT asset_id, hour, min(a) AS lo,
  max(a) AS hi FROM v GROUP BY 1, 2),
g AS (SELECT asset_id, hour, lo + (hi - lo) * k / 64 AS q FROM b, range(65) t(k)), c AS (SELECT g.asset_id, g.hour, q, CASE WHEN a > q
  THEN 3.0 * (a - q) ELSE q - a END AS c FROM g JOIN v ON v.asset_id = g.asset_id AND v.hour = g.hour),
m AS (SELECT asset_id, hour, q, quantile_cont(c, 0.9) AS var FROM c GROUP BY 1, 2, 3),
o AS (SELECT c.asset_id, c.hour, c.q, 0.5 * avg(c) + 0.5 * (any_value(var) + sum(greatest(c - var, 0)) / (0.1 * count(*))) AS objective FROM c
  JOIN m ON m.asset_id = c.asset_id AND m.hour = c.hour AND m.q = c.q GROUP BY 1, 2, 3)
SELECT asset_id, hour, round(arg_min(q, (round(objective, 9), q)), 8) AS nomination_kw, round(min(objective) + 1e-7, 5) AS objective FROM o
  GROUP BY 1, 2""")
def cvar_nomination(spark: SparkSession, d: str) -> DataFrame:
    x = risk.cvar_nomination(i.scenarios(spark, d), 3.0, 1.0).select("asset_id", "hour", "nomination_kw", "objective")
    # amounts are 64ths of cents, of eight decimals; a shift smaller than their steps keeps means from lying half-way between two roundings
    return rounded(rounded(x, "nomination_kw", digits=8).withColumn("objective", F.col("objective") + 1e-7), "objective", digits=5)


# --- ledger -------------------------------------------------------------------------------------
@query("""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS ledger_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT ledger_id, count(*) AS n_entries, min(pos) FILTER (k % 97 = 0 OR k % 101 = 0 OR k % 103 = 0) AS first_broken,
  count(*) FILTER (k % 97 = 0 OR k % 101 = 0 OR k % 103 = 0) = 0 AS chain_ok FROM o GROUP BY 1""")
def ledger_verify(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a ledger, some of whose entries were changed later: payload, hash or link, by rules on the order's key."""
    o = i.table(spark, d, "orders")
    entries = o.select(
        F.col("o_custkey").cast("string").alias("ledger_id"), F.col("o_orderkey").alias("seq"),
        ledger.payload_json("o_orderkey", "o_orderpriority", "o_totalprice").alias("payload")
    )
    where = lambda n: F.col("seq") % n == 0
    changed = ledger.chain(entries).withColumns({
        "payload": F.when(where(97), F.concat("payload", F.lit(" "))).otherwise(F.col("payload")),
        "entry_hash": F.when(where(101), F.reverse("entry_hash")).otherwise(F.col("entry_hash")),
        "prev_hash": F.when(where(103), F.lit("f" * 64)).otherwise(F.col("prev_hash")),
    })
    return ledger.verify(changed)


@query("""WITH o AS (SELECT o_orderpriority AS decision_type, o_totalprice / 1000 AS kw, o_custkey AS dev, CASE WHEN o_totalprice > 200000
  THEN 1.0 ELSE 0.0 END AS shed FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1996-03')
SELECT decision_type, count(*) AS n, round(avg(kw), 6) AS mean_kw, CAST(60 * count(*) AS BIGINT) AS minutes,
  count(DISTINCT dev) FILTER (shed > 1e-9) AS devices FROM o GROUP BY 1""")
def monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    shed = F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0)
    e = i.table(spark, d, "orders").select(
        F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("decision_type"), (F.col("o_totalprice") / 1000).alias("magnitude_kw"), F.lit(60).alias("duration_min"),
        F.array(F.struct(F.col("o_custkey").alias("device_id"), shed.alias("shed_kw"))).alias("affected"),
    )
    return rounded(ledger.monthly_report(e, "1996-03"))


@query("""WITH e AS (SELECT l_suppkey AS device_id, l_discount * l_quantity AS shed, l_quantity AS demand FROM lineitem)
SELECT device_id, round(sum(shed), 6) AS shed_kwh, round(avg(shed / demand), 6) AS share, true AS relative,
  round(avg(shed / demand), 6) AS burden FROM e GROUP BY 1""")
def fairness(spark: SparkSession, d: str) -> DataFrame:
    e = i.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("device_id"), (F.col("l_discount") * F.col("l_quantity")).alias("shed_kw"),
        F.col("l_quantity").alias("demand_kw")
    )
    return rounded(ledger.fairness(e))


@query(f"""WITH {i.BASED} SELECT series_id, CAST(local_date AS VARCHAR) AS target_date, count(*) AS n, round(avg(abs(value - persist)), 6) AS mae,
  round(avg(value - persist), 6) + 0.0 AS bias,
  round(100 * avg(CASE WHEN value BETWEEN persist * 0.5 AND persist * 1.5 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM based
  WHERE snaive IS NOT NULL GROUP BY 1, 2""")
def track_record_latest(spark: SparkSession, d: str) -> DataFrame:
    x = i.based(spark, d).where("snaive is not null")

    def arrays(column: str, issued: int) -> DataFrame:
        g = x.groupBy("series_id", F.col("local_date").cast("string").alias("target_date")).agg(F.array_sort(F.collect_list(F.struct("hour", F.col(column).alias("v")))).alias("s"))
        v = F.col("s.v")
        return g.select(
            "series_id", "target_date", F.lit(issued).alias("issued_utc"), F.transform(v, lambda a: a * 0.5).alias("p10"), v.alias("p50"),
            F.transform(v, lambda a: a * 1.5).alias("p90")
        )

    issued = arrays("snaive", 1).unionByName(arrays("persist", 2))
    actual = arrays("value", 0).select("series_id", "target_date", F.col("p50").alias("actual"))
    return rounded(ledger.track_record(issued, actual))


@query("""WITH s AS (SELECT o_custkey AS utility, CAST(o_orderdate AS DATE) AS fd, o_orderkey AS stored_utc FROM orders)
SELECT utility, CAST(arg_max(fd, stored_utc) AS VARCHAR) AS forecast_date, max(stored_utc) AS stored_utc FROM s GROUP BY 1""")
def latest_forecast(spark: SparkSession, d: str) -> DataFrame:
    o = i.table(spark, d, "orders").select(
        F.col("o_custkey").alias("utility"), F.to_date("o_orderdate").cast("string").alias("forecast_date"),
        F.col("o_orderkey").alias("stored_utc")
    )
    return ledger.latest_saved(o)


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
a AS (SELECT y, y % 19 AS g, y // 100 AS c, y % 100 AS r FROM y),
b AS (SELECT *, (19 * g + c - c // 4 - (c - (c + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM a),
l AS (SELECT *, (32 + 2 * (c % 4) + 2 * (r // 4) - h - r % 4) % 7 AS l FROM b),
m AS (SELECT *, h + l - 7 * ((g + 11 * h + 22 * l) // 451) + 114 AS m FROM l),
e AS (SELECT y, make_date(y, m // 31, m % 31 + 1) AS e FROM m)
SELECT CAST(y AS BIGINT) AS year, count(*) AS n, CAST(min(h) AS VARCHAR) AS first_day, CAST(max(CASE WHEN k = 1
  THEN h END) AS VARCHAR) AS easter_monday FROM
(SELECT y, unnest([make_date(y,1,1), make_date(y,5,1), make_date(y,10,3), make_date(y,12,25), make_date(y,12,26), e - 2, e + 1, e + 39,
  e + 50]) AS h, unnest([0,0,0,0,0,0,1,0,0]) AS k FROM e) GROUP BY 1""")
def holiday_calendar(spark: SparkSession, d: str) -> DataFrame:
    x = relations.holidays(i.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct())
    x = x.withColumn("year", F.year("holiday").cast("long"))
    return x.groupBy("year").agg(
        F.count("*").alias("n"), F.min("holiday").cast("string").alias("first_day"),
        F.max(F.when(F.col("name") == "Ostermontag", F.col("holiday"))).cast("string").alias("easter_monday")
    )


# --- models -------------------------------------------------------------------------------------
@query(f"""WITH {i.DAYS}, tot AS (SELECT day_idx * 24 + hour AS period, 'total' AS node_id, sum(value) * 1.1 AS v FROM days GROUP BY 1),
  lf AS (SELECT day_idx * 24 + hour AS period, series_id AS node_id, value AS v FROM days),
g AS (SELECT period, (any_value(t) - sum(v)) / (count(*) + 1) AS p FROM (SELECT lf.*, tot.v AS t FROM lf JOIN tot USING (period)) GROUP BY 1)
SELECT period, node_id, round(v - p, 5) AS reconciled FROM tot JOIN g USING (period) UNION ALL SELECT period, node_id, round(v + p, 5) FROM lf
  JOIN g USING (period)""")
def mint_ols(spark: SparkSession, d: str) -> DataFrame:
    x = i.days(spark, d).withColumn("period", F.col("day_idx") * 24 + F.col("hour"))
    leaves = x.select("period", F.col("series_id").alias("node_id"), F.col("value"))
    total = leaves.groupBy("period").agg((F.sum("value") * 1.1).alias("value")).select("period", F.lit("total").alias("node_id"), "value")
    names = leaves.select("node_id").distinct()
    h = names.select("node_id", F.col("node_id").alias("leaf_id")).union(names.select(F.lit("total"), "node_id")).withColumn("weight", F.lit(1.0)).withColumn("tree_id", F.lit("t"))
    out = reconcile.reconcile(leaves.union(total).withColumn("tree_id", F.lit("t")), h)
    return rounded(out.select("period", "node_id", "reconciled"), digits=5)


def _backtest(spark: SparkSession, d: str) -> DataFrame:
    return models.rolling_origin(i.days(spark, d), 7)


@query()
def ridge_backtest(spark: SparkSession, d: str) -> DataFrame:
    return metrics.model_table(_backtest(spark, d).select("series_id", "actual", "persist", "snaive", "model"), ["series_id"], ["persist", "snaive", "model"])


@query()
def ridge_ensemble_backtest(spark: SparkSession, d: str) -> DataFrame:
    x = models.rolling_origin(i.days(spark, d), 5, lams=(3.0, 10.0, 30.0))
    return metrics.probabilistic_metrics(x.withColumn("p50", F.col("model")), ["series_id"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query()
def small_load_backtest(spark: SparkSession, d: str) -> DataFrame:
    x = models.rolling_origin(i.days(spark, d), 5, features.FEATURES + features.SMALL, features.small_load_features)
    return metrics.model_table(x.select("series_id", "actual", "snaive", "model"), ["series_id"], ["snaive", "model"])


@query()
def next_day_forecast(spark: SparkSession, d: str) -> DataFrame:
    return models.next_day(i.days(spark, d), cal_days=7)


@query()
def several_days_forecast(spark: SparkSession, d: str) -> DataFrame:
    return models.several_days(i.days(spark, d), 3, cal_days=7)


@query()
def quantile_regression_forecast(spark: SparkSession, d: str) -> DataFrame:
    return backtests.rolling_quantile(i.days(spark, d), 7, every=7)


@query()
def boosted_quantile_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The last seven days' bands by boosted trees that are fitted on the days before."""
    rows = models.with_vector(features.features(i.days(spark, d)), features.FEATURES)
    cut = rows.agg(F.max("day_idx")).first()[0] - 6
    return boosting.boosted_quantiles(rows, train_until=cut).where(F.col("day_idx") >= cut).select("series_id", "day_idx", "hour", "value", "p10", "p50", "p90")


@query()
def pooled_prior(spark: SparkSession, d: str) -> DataFrame:
    rows = models.with_vector(features.features(models.normalised(i.days(spark, d))), features.FEATURES)
    fitted = models.fit_expanding(rows, 1)
    return models.pooled(fitted, models.pool_prior(fitted)).select("series_id", "test_day", F.transform("weights", lambda w: F.round(w, 9)).alias("weights"))


@query()
def calibrated_backtest(spark: SparkSession, d: str) -> DataFrame:
    rows = models.rolling_origin(i.days(spark, d), 12).select("series_id", F.col("day_idx").alias("day"), "hour", "actual", "p10", F.col("model").alias("p50"), "p90")
    scaled = calibration.apply_scales(rows, calibration.rolling_tail_scales(rows, window=7, least=3))
    return metrics.probabilistic_metrics(scaled, ["series_id"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def _daily_errors(spark: SparkSession, d: str) -> DataFrame:
    x = i.based(spark, d).where("snaive is not null")
    return x.groupBy("series_id", "day_idx").agg(F.avg(F.abs(F.col("persist") - F.col("value"))).alias("m"), F.avg(F.abs(F.col("snaive") - F.col("value"))).alias("r"))


def _drawn(length: int, n: int, seed: int = 7) -> str:
    """Common tables up to draws(series_id, rep, m, r): the sums of the blocks that a replicate draws."""
    return f"""{i.BASED}, e AS (SELECT series_id, day_idx, avg(abs(persist - value)) AS m, avg(abs(snaive - value)) AS r FROM based
  WHERE snaive IS NOT NULL GROUP BY 1, 2),
blk AS (SELECT series_id, day_idx // {length} AS block, sum(m) AS m, sum(r) AS r FROM e GROUP BY 1, 2), arr AS (SELECT series_id,
  list(m ORDER BY block) AS m, list(r ORDER BY block) AS r, count(*) AS b FROM blk GROUP BY 1),
st0 AS (SELECT rep, ((rep + {seed * 1000}) % 4294967296)::BIGINT AS z FROM range({n}) t(rep)), st AS (SELECT rep, {stirred("z")} AS z FROM st0),
pl0 AS (SELECT series_id, rep, k, b, m AS ms, r AS rs, (z + k * 7919) % 4294967296 AS z FROM arr, st, range(1000) t(k) WHERE k < b),
  pl AS (SELECT *, ({stirred("z")}) % b AS pick FROM pl0),
draws AS (SELECT series_id, rep, sum(ms[pick + 1]) AS m, sum(rs[pick + 1]) AS r FROM pl GROUP BY 1, 2)"""


@query(f"""WITH {_drawn(1, 400)}, s AS (SELECT series_id, 100 * (1 - m / nullif(r, 0)) AS s FROM draws), ci AS (SELECT series_id,
  quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS p FROM s GROUP BY 1)
SELECT e.series_id, count(*) AS n_days, round(100 * (1 - sum(m) / nullif(sum(r), 0)), 6) AS skill, count(*) FILTER (m < r) AS days_won,
  round(any_value(lo), 6) AS ci_low, round(any_value(hi), 6) AS ci_high, round(any_value(p), 6)::DOUBLE AS p_better
FROM e JOIN ci ON ci.series_id = e.series_id GROUP BY 1""")
def bootstrap_skill(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.skill_interval(_daily_errors(spark, d), ["series_id"], "m", "r", n=400))


@query(f"""WITH {_drawn(3, 400)}, g AS (SELECT series_id, r - m AS g FROM draws)
SELECT series_id, round(quantile_cont(g, 0.1), 6) AS p10, round(quantile_cont(g, 0.5), 6) AS p50, round(quantile_cont(g, 0.9), 6) AS p90,
  round(stddev_pop(g), 6) AS std, round(avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS p_positive FROM g GROUP BY 1""")
def bootstrap_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.band(_daily_errors(spark, d).withColumn("gain", F.col("r") - F.col("m")), ["series_id"], "gain", length=3, n=400))


@query(f"""WITH {_drawn(1, 200)}, s AS (SELECT series_id, 100 * (1 - r / nullif(m, 0)) AS s FROM draws), ci AS (SELECT series_id,
  quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM s GROUP BY 1)
SELECT e.series_id, round(100 * (1 - sum(r) / nullif(sum(m), 0)), 6) AS improvement, round(any_value(lo), 6) AS ci_low,
  round(any_value(hi), 6) AS ci_high FROM e JOIN ci ON ci.series_id = e.series_id GROUP BY 1""")
def bootstrap_difference(spark: SparkSession, d: str) -> DataFrame:
    x = bootstrap.difference_interval(_daily_errors(spark, d), ["series_id"], "m", "r", n=200)
    return rounded(x.select("series_id", "improvement", "ci_low", "ci_high"))


@query(f"""WITH {i.DAYS} SELECT series_id, CAST(local_date AS VARCHAR) AS local_date, count(*) AS n FROM days WHERE hour >= 22 OR hour < 6
  GROUP BY 1, 2""")
def availability_window(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.resample import available

    x = i.days(spark, d).where(available(F.col("hour"), F.lit(22), F.lit(6)))
    return x.groupBy("series_id", F.col("local_date").cast("string").alias("local_date")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT event_id, ts FROM events) SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS local,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS back FROM l""")
def local_time_round_trip(spark: SparkSession, d: str) -> DataFrame:
    e = i.events(spark, d).withColumn("l", fc.local_time("ts"))
    return e.select("event_id", i.stamp("l").alias("local"), i.stamp(fc.localize("l")).alias("back"))


# --- studies ------------------------------------------------------------------------------------
@query(f"""WITH {i.BANDS}, x AS (SELECT series_id, day, hour, actual - p50 AS r FROM bands), a AS (SELECT unnest([6, 9, 12, 15]) AS uh),
s AS (SELECT series_id, day, uh, avg(r) AS mean, sum(pow(0.5, (uh - 1 - hour) / 3.0) * r) / sum(pow(0.5, (uh - 1 - hour) / 3.0)) AS ewm FROM x,
  a WHERE hour < uh GROUP BY 1, 2, 3),
k AS (SELECT series_id, day, uh, 'mean' AS kind, mean AS delta FROM s UNION ALL SELECT series_id, day, uh, 'ewm', ewm FROM s),
  g AS (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS shrink),
d AS (SELECT x.series_id, kind, shrink, k.uh, x.day, avg(abs(r)) AS b, avg(abs(r - shrink * delta)) AS c FROM x JOIN k
  ON x.series_id = k.series_id AND x.day = k.day AND x.hour >= k.uh, g GROUP BY 1, 2, 3, 4, 5)
SELECT series_id, kind, shrink::DOUBLE AS shrink, uh AS update_hour, count(*) AS n_days, round(avg(b), 6) AS mae_before,
  round(avg(c), 6) AS mae_after, round(100 * avg(CASE WHEN c < b - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS helped FROM d GROUP BY 1, 2, 3, 4""")
def intraday_levers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(studies.intraday_levers(i.bands(spark, d)))


@query(f"""WITH {i.SCENARIOS}, k AS (SELECT unnest([1.0, 1.5, 2.0, 3.0, 5.0])::DOUBLE AS ratio),
l AS (SELECT asset_id, hour, list_sort(list(r)) AS s, count(*) AS n FROM scen GROUP BY 1, 2),
p AS (SELECT asset_id, hour, ratio, s, (n - 1) * 0.5 AS a, (n - 1) * (ratio / (ratio + 1.0)) AS b, n FROM l, k),
q AS (SELECT asset_id, hour, ratio, s[floor(a)::INT + 1] + (s[least(floor(a)::INT + 1, n - 1) + 1] - s[floor(a)::INT + 1]) * (a - floor(a)) AS q50,
  s[floor(b)::INT + 1] + (s[least(floor(b)::INT + 1, n - 1) + 1] - s[floor(b)::INT + 1]) * (b - floor(b)) AS qt FROM p),
c AS (SELECT asset_id, hour, ratio, avg(CASE WHEN r > q50 THEN ratio * (r - q50) ELSE q50 - r END) AS a, avg(CASE WHEN r > qt
  THEN ratio * (r - qt) ELSE qt - r END) AS b FROM scen JOIN q USING (asset_id, hour) GROUP BY 1, 2, 3)
SELECT asset_id, ratio, round(sum(a), 5) AS median_cost, round(sum(b), 5) AS optimal_cost,
  round(100 * (1 - sum(b) / nullif(sum(a), 0)), 5) + 0.0 AS saved_percent FROM c GROUP BY 1, 2""")
def asymmetry_costs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(studies.asymmetry_costs(i.scenarios(spark, d)), "median_cost", "optimal_cost", "saved_percent", digits=5)


@query()
def bagged_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = models.with_vector(features.features(i.days(spark, d)), features.FEATURES)
    return studies.bagged_intervals(rows, 5, n_test=4)


@query(f"""WITH {i.DAYS}, q AS (SELECT series_id, day_idx, hour, k, value * (0.2 + k * 0.05) AS v FROM days, range(4) t(k)),
n AS (SELECT series_id, day_idx, 'quarter' AS level, hour * 4 + k AS node, v FROM q UNION ALL SELECT series_id, day_idx, 'hour', hour, sum(v)
  FROM q GROUP BY ALL UNION ALL SELECT series_id, day_idx, 'day', 0, sum(v) FROM q GROUP BY ALL),
l AS (SELECT *, lag(v, 7) OVER (PARTITION BY series_id, level, node ORDER BY day_idx) AS l7 FROM n),
b AS (SELECT *, l7 + 0.5 * coalesce(avg(v - l7) OVER (PARTITION BY series_id, level, node ORDER BY day_idx ROWS BETWEEN 7 PRECEDING
  AND 1 PRECEDING), 0.0) AS y, max(day_idx) OVER (PARTITION BY series_id) AS last FROM l),
t AS (SELECT * FROM b WHERE l7 IS NOT NULL AND day_idx > last - 4),
h AS (SELECT qq.series_id, qq.day_idx, qq.node // 4 AS hour, sum(qq.y) AS yq, any_value(hh.y) AS yh, any_value(dd.y) AS yd FROM t qq JOIN t hh
  ON hh.level = 'hour' AND hh.series_id = qq.series_id AND hh.day_idx = qq.day_idx AND hh.node = qq.node // 4
  JOIN t dd ON dd.level = 'day' AND dd.series_id = qq.series_id AND dd.day_idx = qq.day_idx WHERE qq.level = 'quarter' GROUP BY 1, 2, 3),
s AS (SELECT *, (sum(yq) OVER w + sum(yh) OVER w + yd) / 3 AS total FROM h WINDOW w AS (PARTITION BY series_id, day_idx)), sh AS (SELECT *,
  (yq + yh - (total - yd) / 24) / 2 AS fixed FROM s),
f AS (SELECT t.series_id, t.level, t.v, t.y, CASE level WHEN 'day' THEN sh.total WHEN 'hour' THEN sh.fixed
  ELSE t.y - (sh.fixed - sh.yh) / 4 - (sh.total - sh.yd) / 96 END AS r
  FROM t JOIN sh ON t.series_id = sh.series_id AND t.day_idx = sh.day_idx AND sh.hour = CASE level WHEN 'day' THEN 0 WHEN 'hour' THEN t.node
  ELSE t.node // 4 END)
SELECT series_id, level, round(avg(abs(y - v)), 6) AS mae_before, round(avg(abs(r - v)), 6) AS mae_after, true AS coherent FROM f GROUP BY 1, 2""")
def temporal_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Given forecasts of each level (a week ago and half the level's own bias), made coherent by two passes."""
    x = _quarters(spark, d).withColumn("at", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("slot") * n / 96).alias("node")) for k, n in studies.LEVELS.items()))))
    x = x.groupBy("series_id", "day_idx", "at.level", "at.node").agg(F.sum("value").alias("actual"))
    by = Window.partitionBy("series_id", "level", "node").orderBy("day_idx")
    x = x.withColumn("l7", F.lag("actual", 7).over(by)).withColumn("miss", F.col("actual") - F.col("l7"))
    x = x.withColumn("value", F.col("l7") + 0.5 * F.coalesce(F.avg("miss").over(by.rowsBetween(-7, -1)), F.lit(0.0)))
    x = x.withColumn("last", F.max("day_idx").over(Window.partitionBy("series_id"))).where("l7 is not null and day_idx > last - 4")
    name = F.when(F.col("level") == "day", "day").otherwise(F.concat(F.substring("level", 1, 1), F.lpad(F.col("node").cast("string"), 2, "0")))
    x = x.select(F.col("series_id").alias("tree_id"), F.col("day_idx").alias("period"), name.alias("node_id"), "level", "value", "actual")
    tree = reconcile.temporal_tree(spark)
    after = reconcile.reconcile_tree(x, tree, "wls_struct").join(x.drop("value"), ["tree_id", "period", "node_id"])
    scores = studies.level_scores(after, tree).withColumnRenamed("tree_id", "series_id")
    return rounded(scores.select("series_id", "level", "mae_before", "mae_after", (F.col("gap_after") < 1e-9).alias("coherent")))


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    """Each hour as four quarter hours of unequal parts."""
    q = i.days(spark, d).select("series_id", "day_idx", "local_date", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "hour", "value")
    return q.select("series_id", "day_idx", "local_date", (F.col("hour") * 4 + F.col("k")).alias("slot"), (F.col("value") * (0.2 + F.col("k") * 0.05)).alias("value"))


@query()
def temporal_fitted(spark: SparkSession, d: str) -> DataFrame:
    """Fitted forecasts at 96, 24 and 1 steps a day, made coherent under their shrunk error covariance."""
    out = studies.temporal_reconciliation(_quarters(spark, d), 3, "mint_shrink", 4, cal_days=7, min_history=18)
    return out["backtest"]


@query("""WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
y AS (SELECT DISTINCT year(o_orderdate) AS period FROM orders),
o AS (SELECT o_custkey, year(o_orderdate) AS period, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
l AS (SELECT c.*, y.period, coalesce(o.v, 0.0) AS v FROM c CROSS JOIN y LEFT JOIN o ON o.o_custkey = c.c_custkey AND o.period = y.period),
n0 AS (SELECT period, n_regionkey AS r, c_nationkey AS n, sum(v) AS s, count(*) AS k FROM l GROUP BY ALL),
n1 AS (SELECT *, s * (0.9 + 0.01 * n) AS y0, (s * (0.9 + 0.01 * n) / k + s / k) / (2.0 / k) AS est, k / 2.0 AS spread FROM n0),
r0 AS (SELECT period, r, sum(est) AS s, sum(spread) AS sv, sum(n1.s) AS raw, sum(k) AS k FROM n1 GROUP BY ALL),
r1 AS (SELECT *, (raw * (1.1 - 0.02 * r) / k + s / sv) / (1.0 / k + 1 / sv) AS est, 1 / (1.0 / k + 1 / sv) AS spread FROM r0),
t0 AS (SELECT period, sum(est) AS s, sum(spread) AS sv, sum(raw) AS raw, sum(k) AS k FROM r1 GROUP BY ALL),
t1 AS (SELECT *, (raw * 1.02 / k + s / sv) / (1.0 / k + 1 / sv) AS fixed FROM t0),
r2 AS (SELECT r1.*, r1.est + r1.spread * (t1.fixed - t1.s) / t1.sv AS fixed FROM r1 JOIN t1 USING (period)),
n2 AS (SELECT n1.*, n1.est + n1.spread * (r2.fixed - r2.s) / r2.sv AS fixed FROM n1 JOIN r2 ON n1.period = r2.period AND n1.r = r2.r),
l2 AS (SELECT l.period, 'c' || c_custkey AS node_id, l.v + (n2.fixed - n2.s) / n2.k AS fixed FROM l JOIN n2 ON n2.period = l.period AND n2.n = l.c_nationkey),
f AS (SELECT period, node_id, fixed FROM l2 UNION ALL SELECT period, 'n' || n, fixed FROM n2 UNION ALL SELECT period, 'r' || r, fixed FROM r2
  UNION ALL SELECT period, 'all', fixed FROM t1)
SELECT CAST(period AS INT) AS period, node_id, round(fixed, 2) + 0.0 AS reconciled FROM f""")
def mint_tree(spark: SparkSession, d: str) -> DataFrame:
    """Yearly sums of customers, nations, regions and all, each level forecast apart (as if with a bias), made coherent by leaf counts."""
    c = i.table(spark, d, "customer").join(i.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    o = i.table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("period"), "o_totalprice")
    years = F.broadcast(o.select("period").distinct())  # one row a year
    sums = o.groupBy(F.col("o_custkey").alias("c_custkey"), "period").agg(F.sum("o_totalprice").alias("v"))
    leaves = relations._cut(c.crossJoin(years).join(sums, ["c_custkey", "period"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))))  # every level sums them up
    nation, region = F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    base = [leaves.select("period", F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.col("v").alias("value"))]
    for node, factor in ((nation, 0.9 + 0.01 * F.col("c_nationkey")), (region, 1.1 - 0.02 * F.col("n_regionkey")), (F.lit("all"), F.lit(1.02))):
        base.append(leaves.groupBy("period", node.alias("node_id"), factor.alias("f")).agg((F.sum("v") * F.col("f")).alias("value")).select("period", "node_id", "value"))
    tree = [
        c.select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), nation.alias("parent_id")), c.select(nation.alias("node_id"), region.alias("parent_id")).distinct(),
        c.select(region.alias("node_id"), F.lit("all").alias("parent_id")).distinct(), spark.range(1).select(F.lit("all").alias("node_id"), F.lit(None).cast("string").alias("parent_id")),
    ]
    t = relations.dealt_union(["node_id"], *tree).withColumn("tree_id", F.lit(0))
    out = reconcile.reconcile_tree(relations.dealt_union(["node_id"], *base).withColumn("tree_id", F.lit(0)), t, "wls_struct")
    return rounded(out.select("period", "node_id", "reconciled"), digits=2)


@query()
def generation_bias(spark: SparkSession, d: str) -> DataFrame:
    x = i.days(spark, d).withColumn("proxy_in", F.col("value") * 0.8 + 5)
    return studies.generation_bias(x, "proxy_in", 10).groupBy("series_id").agg(F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("mae"))


@query()
def service_run(spark: SparkSession, d: str) -> DataFrame:
    from . import service

    return service.run_forecast(i.load(spark, d), "UTC", n_test=7, cal_days=7)["metrics"]


@query()
def blind_challenge(spark: SparkSession, d: str) -> DataFrame:
    from . import service

    a = i.load(spark, d)
    older = a.withColumn("ts", F.col("ts") - F.expr("interval 30 days"))
    return service.blind_challenge(a.unionByName(older), "UTC", 28, 200)["skill"]
