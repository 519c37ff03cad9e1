"""Forecast, drift, settlement and risk metrics: plain aggregations over rows of any number of groups.

Missing values (null, NaN, infinite) are dropped pairwise before anything is averaged; ratios with
a zero denominator are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite
from .relations import _cut


def pairs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns}).na.drop(subset=list(columns))


def _meet(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with what is known of their group; without keys that is one row."""
    return rows.join(groups, list(by)) if by else rows.crossJoin(groups)


def _counted(rows: DataFrame, by: Sequence[str], value: str, **counts: Column) -> DataFrame:
    """Equal values of a group counted first: (by, value, counts)."""
    return rows.groupBy(*by, value).agg(*(F.sum(c.cast("long")).alias(n) for n, c in counts.items()))


def _meet_parts(counted: DataFrame, groups: DataFrame, by: Sequence[str], value: str, parts: int = 64) -> DataFrame:
    """_meet() of distinct values, which are dealt to some shares of their group: no task takes a group as a whole, however few there are."""
    if not by:
        return counted.crossJoin(groups)
    x = counted.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(parts)))
    return x.join(x.select(*by, "_part").distinct().join(groups, list(by)), [*by, "_part"]).drop("_part")


def cumulative(values: DataFrame, by: Sequence[str], value: str, counts: Sequence[str], blocks: int = 64) -> DataFrame:
    """Rows with distinct values in each group -> adds upto_<c> (sum of c over values up to this one) and all_<c>. Values
    go to blocks between approximate quantiles, sums run inside blocks and over block totals, so no
    task scans a group as a whole. Where the borders lie doesn't change the result, but rows and totals must share them: approximate
    quantiles follow the order in which tasks are merged, so they are written once."""
    levels = F.array(*(F.lit(k / blocks) for k in range(1, blocks)))
    edges = _cut(values.groupBy(*by).agg(F.percentile_approx(value, levels).alias("edges")))
    x = _meet_parts(values, edges, by, value)
    x = x.withColumn("block", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")
    inside = W.partitionBy(*by, "block").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    totals = x.groupBy(*by, "block").agg(*(F.sum(c).alias(f"in_{c}") for c in counts))
    before = group.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *by, "block", *(F.coalesce(F.sum(f"in_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in counts),
        *(F.sum(f"in_{c}").over(group).alias(f"all_{c}") for c in counts)
    )
    x = x.select("*", *(F.sum(c).over(inside).alias(f"own_{c}") for c in counts)).join(totals, [*by, "block"])
    return x.select(*values.columns, *((F.col(f"own_{c}") + F.col(f"before_{c}")).alias(f"upto_{c}") for c in counts), *(f"all_{c}" for c in counts))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, levels: Sequence[float], name: str = "q") -> DataFrame:
    """(by, n, name: array of the interpolated quantiles of a column without nulls). Exact, without a buffer of a
    group's values: equal values are counted first, and each quantile takes two of them by position."""
    x = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    x = cumulative(x, by, "v", ["k"])
    first, last = F.col("upto_k") - F.col("k"), F.col("upto_k") - 1
    parts = []
    for i, level in enumerate(levels):
        at = (F.col("all_k") - 1) * F.lit(float(level))
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            parts.append(F.max(F.when((place >= first) & (place <= last), F.col("v"))).alias(f"{side}{i}"))
    x = x.groupBy(*by).agg(F.max("all_k").alias("n"), *parts)

    def between(i: int, level: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(level))
        share = at - F.floor(at)
        return F.col(f"lo{i}") * (1 - share) + F.col(f"hi{i}") * share

    return x.select(*by, "n", F.array(*(between(i, q) for i, q in enumerate(levels))).alias(name))


def point_metrics(rows: DataFrame, by: Sequence[str], pred: str = "pred", actual: str = "actual") -> DataFrame:
    e = F.col(pred) - F.col(actual)
    return (
        pairs(rows, pred, actual)
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.avg(F.abs(e)).alias("mae"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            (100 * F.avg(F.try_divide(F.abs(e), F.abs(F.col(actual))))).alias("mape"),
            F.avg(e).alias("bias"),
        )
    )


def model_table(
    rows: DataFrame, by: Sequence[str], models: Sequence[str], actual: str = "actual", reference: str = "snaive",
    scale: DataFrame | None = None
) -> DataFrame:
    """Wide model columns -> one row per group and model with skill against the reference (percent)
    and, with scale (by, scale), MASE."""
    long = rows.unpivot([*by, actual], list(models), "model", "pred")
    m = point_metrics(long, [*by, "model"], "pred", actual)
    ref = F.max(F.when(F.col("model") == reference, F.col("mae"))).over(W.partitionBy(*by))
    m = m.withColumn("skill", (1 - F.try_divide("mae", ref)) * 100)
    if scale is not None:
        m = m.join(scale, list(by)).withColumn("mase", F.try_divide("mae", "scale")).drop("scale")
    return m


def day_lag_scale(days: DataFrame, first: int, n_test: int) -> DataFrame:
    """Mean absolute day-to-day change over [first, number of days - n_test): the MASE scale."""
    hour = W.partitionBy("series_id", "hour").orderBy("day_idx")
    last = F.max("day_idx").over(W.partitionBy("series_id")) + 1
    x = days.withColumn("step", F.abs(F.col("value") - F.lag("value").over(hour))).withColumn("last", last)
    return x.where((F.col("day_idx") >= first) & (F.col("day_idx") < F.col("last") - n_test)).groupBy("series_id").agg(F.avg("step").alias("scale"))


def pinball(actual: Column, quantile: Column, level: float) -> Column:
    d = actual - quantile
    return F.greatest(level * d, (level - 1) * d)


def probabilistic_metrics(rows: DataFrame, by: Sequence[str], levels: dict[str, float], low: str = "p10", high: str = "p90", actual: str = "actual") -> DataFrame:
    """Mean pinball loss per level, their mean (a CRPS proxy), inclusive coverage percent and width."""
    a = F.col(actual)
    losses = {c: F.avg(pinball(a, F.col(c), t)) for c, t in levels.items()}
    out = pairs(rows, actual, *levels).groupBy(*by).agg(
        F.count("*").alias("n"),
        *(x.alias(f"pinball_{c}") for c, x in losses.items()),
        (100 * F.avg(a.between(F.col(low), F.col(high)).cast("double"))).alias("coverage"),
        F.avg(F.col(high) - F.col(low)).alias("width"),
    )
    return out.withColumn("crps_proxy", sum((F.col(f"pinball_{c}") for c in levels), F.lit(0.0)) / len(levels))


def daily_mae(rows: DataFrame, by: Sequence[str], pred: str, actual: str = "actual", day: str = "day_idx") -> DataFrame:
    return pairs(rows, pred, actual).groupBy(*by, day).agg(F.avg(F.abs(F.col(pred) - F.col(actual))).alias("mae"))


def residual_quantiles(rows: DataFrame, by: Sequence[str], residual: str = "residual", levels: Sequence[float] = (0.1, 0.9)) -> DataFrame:
    q = F.percentile(residual, F.array(*(F.lit(x) for x in levels)))
    return pairs(rows, residual).groupBy(*by).agg(F.count("*").alias("n"), *(q[i].alias(f"q{round(100 * x):02d}") for i, x in enumerate(levels)))


# --- settlement ---------------------------------------------------------------------------------
def imbalance_premium(rows: DataFrame, by: Sequence[str], scheduled: str, actual: str, rebap: str, spot: str | None = None) -> DataFrame:
    """Cost of imbalance against the spread: total, bias part n * mean(e) * mean(s), correlation part."""
    x = rows.withColumn("_e", finite(F.col(actual) - F.col(scheduled))).withColumn("_s", finite(F.col(rebap) - (F.col(spot) if spot else 0)))
    x = x.na.drop(subset=["_e", "_s"]).groupBy(*by)
    return x.agg(
        F.count("*").alias("n"),
        F.sum(F.col("_e") * F.col("_s")).alias("total"),
        (F.count("*") * F.avg("_e") * F.avg("_s")).alias("bias_part"),
        (F.count("*") * F.covar_pop("_e", "_s")).alias("correlation_part"),
        F.sum(F.abs("_e")).alias("volume"),
    )


def forecast_saving(rows: DataFrame, by: Sequence[str], schedule_a: str, schedule_b: str, rebap: str, spot: str) -> DataFrame:
    """premium(A) - premium(B) = sum of (B - A) * spread; the actual energy cancels."""
    part = finite((F.col(schedule_b) - F.col(schedule_a)) * (F.col(rebap) - F.col(spot)))
    return rows.withColumn("_p", part).na.drop(subset=["_p"]).groupBy(*by).agg(F.count("*").alias("n"), F.sum("_p").alias("saving"))


def surplus_deficit(rows: DataFrame, by: Sequence[str], forecast: str, actual: str, price: str | None = None, dt_h: float = 1.0) -> DataFrame:
    d = (F.col(actual) - F.col(forecast)) * dt_h
    out = [
        F.sum(F.greatest(d, F.lit(0.0))).alias("more"),
        F.sum(F.greatest(-d, F.lit(0.0))).alias("less"),
        F.sum(d).alias("net"),
        F.sum(F.abs(d)).alias("volume"),
    ]
    if price:
        out.append(F.sum(F.abs(d) * F.col(price)).alias("cost"))
    return pairs(rows, forecast, actual).groupBy(*by).agg(*out)


def spread_stats(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Of |value|: n, mean, median, quartiles and 95th percentile; and the signed mean."""
    x = rows.withColumn("_v", finite(value)).na.drop(subset=["_v"]).withColumn("_a", F.abs("_v"))
    q = quantiles(x, by, "_a", (0.5, 0.25, 0.75, 0.95)).drop("n")
    base = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_a").alias("mean"), F.avg("_v").alias("signed_mean"))
    return _meet(base, q, by).select(*by, "n", "mean", *(F.col("q")[i].alias(c) for i, c in enumerate(("median", "p25", "p75", "p95"))), "signed_mean")


def saving_estimates(stats: DataFrame, delta_mae: float, hours: float = 8760.0) -> DataFrame:
    """Yearly saving at the median and quartile spreads and at |mean signed spread|."""
    if delta_mae < 0:
        raise ValueError("a saving needs a non-negative error reduction")
    k = delta_mae * hours
    return stats.select("*", *((F.col(c) * k).alias(f"saving_{c}") for c in ("median", "p25", "p75")), (F.abs("signed_mean") * k).alias("saving_expected"))


def realized_settlement(rows: DataFrame, by: Sequence[str], baseline: str, model: str, actual: str, rebap: str, spot: str, day: str) -> DataFrame:
    """Premiums of two schedules, their difference, and that per year by 365 / days."""
    s, b, m = (F.col(rebap) - F.col(spot)), F.col(actual) - F.col(baseline), F.col(actual) - F.col(model)
    x = pairs(rows, baseline, model, actual, rebap, spot).groupBy(*by)
    out = x.agg(F.count_distinct(day).alias("n_days"), F.sum(b * s).alias("premium_baseline"), F.sum(m * s).alias("premium_model"))
    saving = F.col("premium_baseline") - F.col("premium_model")
    return out.withColumn("saving", saving).withColumn("saving_year", saving * 365 / F.col("n_days"))


def cvar(rows: DataFrame, by: Sequence[str], cost: str, alpha: float = 0.95) -> DataFrame:
    x = pairs(rows, cost)
    at = quantiles(x, by, cost, [alpha]).select(*by, F.col("q")[0].alias("var"))
    x = _meet_parts(_counted(x, by, cost, k=F.lit(1)), at, by, cost)
    beyond = F.sum(F.col("k") * F.greatest(F.col(cost) - F.col("var"), F.lit(0.0))) / F.sum("k")
    return x.groupBy(*by).agg(F.first("var").alias("var"), (F.first("var") + beyond / (1 - alpha)).alias("cvar"))


# --- drift --------------------------------------------------------------------------------------
def psi(errors: DataFrame, by: Sequence[str], value: str = "error", recent: str = "recent", bins: int = 10, eps: float = 1e-4, least: int = 10) -> DataFrame:
    """Population stability index of recent against reference rows on the reference's deciles."""
    x = pairs(errors, value)
    edges = quantiles(x.where(~F.col(recent)), by, value, [k / bins for k in range(1, bins)], "edges").where(F.col("n") >= least).drop("n")
    placed = _meet_parts(_counted(x, by, value, r=~F.col(recent), c=F.col(recent)), edges, by, value)
    placed = placed.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value))))
    counts = placed.groupBy(*by, "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    total = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    shares = counts.withColumn("pr", F.greatest(F.lit(eps), F.try_divide("r", F.sum("r").over(total)))).withColumn(
        "pc", F.greatest(F.lit(eps), F.coalesce(F.try_divide("c", F.sum("c").over(total)), F.lit(eps)))
    )
    term = (F.col("pc") - F.col("pr")) * F.log(F.col("pc") / F.col("pr"))  # bins without rows add nothing
    return shares.groupBy(*by).agg(F.sum(term).alias("psi"))


def ks(errors: DataFrame, by: Sequence[str], value: str = "error", recent: str = "recent") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance; ties count together."""
    x = pairs(errors, value).groupBy(*by, value).agg(F.sum((~F.col(recent)).cast("long")).alias("r"), F.sum(F.col(recent).cast("long")).alias("c"))
    x = cumulative(x, by, value, ["r", "c"])
    d = F.abs(F.try_divide("upto_r", "all_r") - F.try_divide("upto_c", "all_c"))
    nr, nc = F.first("all_r"), F.first("all_c")
    return x.withColumn("d", d).groupBy(*by).agg(F.max("d").alias("ks"), (1.358 * F.sqrt(F.try_divide(nr + nc, nr * nc))).alias("ks_critical"))


STATUS = ["stable", "watch", "drift"]


def drift_report(
    errors: DataFrame, by: Sequence[str], value: str = "error", recent: str = "recent", psi_at=(0.1, 0.25), mae_at=(1.15, 1.30), bias_at=(0.25, 0.5)
) -> DataFrame:
    """Bias shift in reference standard deviations, MAE ratio, PSI, KS and the worst of their levels.
    Exceeding the KS bound means watch."""
    v, r = F.col(value), F.col(recent)
    x = pairs(errors, value)
    base = x.groupBy(*by).agg(
        F.avg(F.when(~r, v)).alias("bias_ref"),
        F.avg(F.when(r, v)).alias("bias_recent"),
        F.stddev_pop(F.when(~r, v)).alias("std_ref"),
        F.avg(F.when(~r, F.abs(v))).alias("mae_ref"),
        F.avg(F.when(r, F.abs(v))).alias("mae_recent"),
    )
    shift = F.abs(F.col("bias_recent") - F.col("bias_ref"))
    inf = F.lit(float("inf"))
    out = (
        base.withColumn("bias_shift_std", F.when(F.col("std_ref") > 1e-12, shift / F.col("std_ref")).when(shift > 1e-12, inf).otherwise(0.0))
        .withColumn("mae_ratio", F.when(F.col("mae_ref") > 1e-12, F.col("mae_recent") / F.col("mae_ref")).when(F.col("mae_recent") > 1e-12, inf).otherwise(1.0))
        .join(psi(errors, by, value, recent), list(by), "left")
        .join(ks(errors, by, value, recent), list(by), "left")
    )
    level = lambda c, at: F.when(F.col(c) >= at[1], 2).when(F.col(c) >= at[0], 1).otherwise(0)
    worst = F.greatest(level("bias_shift_std", bias_at), level("mae_ratio", mae_at), level("psi", psi_at), F.when(F.col("ks") > F.col("ks_critical"), 1).otherwise(0))
    return out.withColumn("level", worst).withColumn("status", F.element_at(F.array(*(F.lit(s) for s in STATUS)), F.col("level") + 1))


def coverage_report(
    rows: DataFrame, by: Sequence[str], low: str = "p10", high: str = "p90", actual: str = "actual", nominal: float = 0.8,
    tolerance: float = 0.1
) -> DataFrame:
    a = F.col(actual)
    out = pairs(rows, low, high, actual).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(a.between(F.col(low), F.col(high)).cast("double")).alias("coverage"),
        F.avg((a < F.col(low)).cast("double")).alias("below"),
        F.avg((a > F.col(high)).cast("double")).alias("above"),
    )
    return out.withColumn("drift", F.abs(F.col("coverage") - nominal) > tolerance)


def lag1_correlation(days: DataFrame, by: Sequence[str], value: str, day: str = "day_idx") -> DataFrame:
    """Pearson correlation of each day's value with the day before, each side by its own mean."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(day))
    return days.withColumn("_b", before).where(F.col("_b").isNotNull() & F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.corr("_b", value).alias("r1"))


def gini(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Gini coefficient of the values clamped at 0; 0 if they sum to nothing."""
    x = pairs(rows, value).withColumn("_v", F.greatest(F.col(value), F.lit(0.0)))
    x = x.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("_v")))
    n, s = F.count("*"), F.sum("_v")
    g = F.when(s > 0, 2 * F.sum(F.col("_i") * F.col("_v")) / (n * s) - (n + 1) / n).otherwise(0.0)
    return x.groupBy(*by).agg(n.alias("n"), g.alias("gini"))


def moments(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Population standard deviation, skewness and excess kurtosis."""
    return pairs(rows, value).groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"))


def sign_test(groups: DataFrame, wins: str, n: str) -> DataFrame:
    """One-sided binomial p: sum of C(n, i) / 2^n for i from wins to n, folded over the logarithms of the coefficients: 2^-n itself
    is no double beyond some thousand."""
    terms = F.sequence(F.lit(0), F.col(n).cast("int"))

    def step(acc: Column, i: Column) -> Column:
        c = F.when(i == 0, 0.0).otherwise(acc["c"] + F.log((F.col(n) - i + 1) / i))
        return F.struct(c.alias("c"), (acc["p"] + F.when(i >= F.col(wins), F.exp(c - F.col(n) * F.log(F.lit(2.0)))).otherwise(0.0)).alias("p"))

    p = F.aggregate(terms, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("p")), step, lambda acc: acc["p"])
    return groups.withColumn("p_value", p)
