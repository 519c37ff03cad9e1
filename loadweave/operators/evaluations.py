"""Evaluations over many series at once: weather lift, pooling by history length, benchmarks by corpus, settlement bands.

Each compares forecasts of the same days; series are keys, so a corpus is one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import backtests, bootstrap, features, metrics, models


def _daily(rows: DataFrame, name: str) -> DataFrame:
    e = lambda c: F.avg(F.abs(F.col(c) - F.col("actual")))
    return rows.groupBy("series_id", "day_idx").agg(e("model").alias(name), e("snaive").alias(f"{name}_ref"))


def paired_lift(plain: DataFrame, other: DataFrame, n_boot: int = 1000) -> DataFrame:
    """Two backtests of the same series: (series_id, n_days, mae_plain, mae_other, skill_plain, skill_other against the
    seasonal naive forecast, lift in points, improvement with its interval, p_better), by days both have."""
    both = _daily(plain, "plain").join(_daily(other, "other"), ["series_id", "day_idx"])
    skill = lambda c: 100 * (1 - F.try_divide(F.avg(c), F.avg("plain_ref")))
    point = both.groupBy("series_id").agg(
        F.avg("plain").alias("mae_plain"), F.avg("other").alias("mae_other"), skill("plain").alias("skill_plain"),
        skill("other").alias("skill_other")
    )
    ci = bootstrap.difference_interval(both, ["series_id"], "plain", "other", n=n_boot).select("series_id", "n_days", "improvement", "ci_low", "ci_high", "p_better")
    return point.withColumn("lift", F.col("skill_other") - F.col("skill_plain")).join(ci, "series_id")


def weather_lift(
    days: DataFrame, weather: Sequence[str], n_test: int, cal_days: int = 28, holidays: DataFrame | None = None, n_boot: int = 1000,
    least_days: int = 0
) -> DataFrame:
    """Backtests with and without the weather columns of days on the same days (those whose weather is complete), and
    the coverage and width of 80 and 90 % conformal bands with weather. Series with fewer days than least_days go."""
    known = days.groupBy("series_id", "local_date").agg(F.count_if(sum((F.col(c).isNull().cast("int") for c in weather), F.lit(0)) > 0).alias("missing"))
    kept = days.join(known.where("missing = 0").select("series_id", "local_date"), ["series_id", "local_date"], "left_semi").drop("day_idx")
    kept = kept.withColumn("day_idx", F.dense_rank().over(W.partitionBy("series_id").orderBy("local_date")) - 1)
    enough = kept.groupBy("series_id").agg(F.max("day_idx").alias("last")).where(F.col("last") + 1 >= least_days).select("series_id")
    kept = kept.join(enough, "series_id", "left_semi")
    out = paired_lift(models.rolling_origin(kept, n_test, holidays=holidays), models.rolling_origin(kept, n_test, holidays=holidays, weather=weather), n_boot)
    for level, alpha in ((80, 0.2), (90, 0.1)):
        b = backtests.rolling_conformal(kept, n_test, "cqr", alpha, cal_days, holidays=holidays, weather=weather)
        out = out.join(
            b.groupBy("series_id").agg(
                (100 * F.avg(F.col("actual").between(F.col("p10"), F.col("p90")).cast("double"))).alias(f"coverage{level}"), F.avg(F.col("p90") - F.col("p10")).alias(f"width{level}")
            ),
            "series_id",
        )
    return out


def lift_summary(lifts: DataFrame, by: Sequence[str] = (), value: str = "lift") -> DataFrame:
    """Over series: number, wins, median and quartiles of a lift and the one-sided sign test."""
    x = lifts.where(F.col(value).isNotNull())
    q = metrics.quantiles(x, by, value, (0.25, 0.5, 0.75)).select(*by, *(F.col("q")[i].alias(c) for i, c in enumerate(("p25", "median", "p75"))))
    n = x.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(value) > 0).alias("wins"))
    return metrics.sign_test(metrics._meet(n, q, by), "wins", "n")


def pooling_by_history(days: DataFrame, lengths: Sequence[int], n_test: int, lam: float = 10.0, tau_days: float = 30.0) -> DataFrame:
    """(series_id, history_days, mae_own, mae_pooled, improvement): one ridge on the last history_days before the test days
    against the same shrunk toward the mean of all other series' weights (each series in units of its own mean,
    its whole training time). Leave-one-out: a series never enters its own prior."""
    ends = days.groupBy("series_id").agg((F.max("day_idx") + 1 - n_test).alias("until"))
    x = days.join(ends, "series_id")
    history = F.explode(F.array(*(F.lit(int(n)) for n in lengths)))

    def unit(part: DataFrame) -> DataFrame:
        mean = F.avg(F.when((F.col("day_idx") >= F.col("from_day")) & (F.col("day_idx") < F.col("until")), F.col("value"))).over(W.partitionBy("series_id"))
        return part.withColumn("unit", mean).where("unit > 0").withColumn("value", F.col("value") / F.col("unit"))

    def rows(part: DataFrame) -> DataFrame:
        return models.with_vector(features.features(part), features.FEATURES)

    first = F.lit(features.FIRST)
    whole = rows(unit(x.withColumn("from_day", first))).where("day_idx < until")
    prior = models.fit_expanding(whole, 0, (lam,), False).select("series_id", F.posexplode("weights").alias("i", "w"))
    total = prior.groupBy("i").agg(F.sum("w").alias("s"), F.count("*").alias("n")).where("n > 1")
    others = prior.join(total, "i").select("series_id", "i", ((F.col("s") - F.col("w")) / (F.col("n") - 1)).alias("w"))
    others = others.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("s")).select("series_id", F.col("s.w").alias("prior"))
    short = x.select("*", history.alias("history_days")).withColumn("from_day", F.greatest(first, F.col("until") - F.col("history_days")))
    short = short.withColumnRenamed("series_id", "origin").withColumn("series_id", F.concat_ws("@", "origin", "history_days"))
    short = rows(unit(short))
    own = models.fit_expanding(short.where("day_idx < until and day_idx >= from_day"), 0, (lam,), False).select("series_id", "weights", "n_rows")
    met = short.where("day_idx >= until and value is not null").join(own, "series_id").join(others.withColumnRenamed("series_id", "origin"), "origin")
    a = F.col("n_rows") / (F.col("n_rows") + 24 * tau_days)
    pooled = F.zip_with("weights", "prior", lambda w, p: a * w + (1 - a) * p)
    error = lambda w: F.avg(F.abs(F.col("base") + models.dot("x", w) - F.col("value")) * F.col("unit"))
    out = met.groupBy(F.col("origin").alias("series_id"), "history_days").agg(error("weights").alias("mae_own"), error(pooled).alias("mae_pooled"))
    return out.withColumn("improvement", 100 * (1 - F.try_divide("mae_pooled", "mae_own")))


def corpus_benchmark(days: DataFrame, entries: DataFrame, n_test: int, n_boot: int = 1000, **options) -> DataFrame:
    """entries(series_id, corpus, country): per series errors of both baselines and the model, skill with its interval, and
    whether it is significant. National loads are a corpus of their own: a summary by corpus never mixes them."""
    b = models.rolling_origin(days.join(entries.select("series_id"), "series_id", "left_semi"), n_test, **options)
    table = metrics.model_table(b.select("series_id", "actual", "persist", "snaive", "model"), ["series_id"], ["persist", "snaive", "model"]).where("model = 'model'")
    daily = _daily(b, "m")
    ci = bootstrap.skill_interval(daily, ["series_id"], "m", "m_ref", n=n_boot).select("series_id", "n_days", "ci_low", "ci_high", "p_better")
    return table.drop("model").join(ci, "series_id").join(entries, "series_id").withColumn("significant", F.col("ci_low") > 0)


def corpus_summary(results: DataFrame, by: Sequence[str] = ("corpus",)) -> DataFrame:
    """Per corpus: series, significant ones, mean skill and mean MAPE."""
    return results.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("significant").alias("n_significant"), F.avg("skill").alias("mean_skill"),
        F.avg("mape").alias("mean_mape")
    )


def settlement_band(
    rows: DataFrame, by: Sequence[str], baseline: str, model: str, actual: str, rebap: str, spot: str, day: str, length: int = 7,
    n_boot: int = 1000
) -> DataFrame:
    """realized_settlement() with the block-bootstrap band of the daily savings."""
    saving = (F.col(model) - F.col(baseline)) * (F.col(rebap) - F.col(spot))
    daily = metrics.pairs(rows, baseline, model, actual, rebap, spot).groupBy(*by, day).agg(F.sum(saving).alias("gain"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(day)) - 1
    band = bootstrap.band(daily.withColumn("pos", place), by, "gain", "pos", length, n_boot)
    return metrics.realized_settlement(rows, by, baseline, model, actual, rebap, spot, day).join(band, list(by))


def calibration_summary(rows: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Of a backtest with calibrate: coverage, pinball loss and both tail shares (percent), as forecast and calibrated."""
    share = lambda c: 100 * F.avg(c.cast("double"))
    out = []
    for tail, low, high in (("", "p10", "p90"), ("_cal", "p10_cal", "p90_cal")):
        a, lo, hi = F.col("actual"), F.col(low), F.col(high)
        loss = (metrics.pinball(a, lo, 0.1) + metrics.pinball(a, F.col("model"), 0.5) + metrics.pinball(a, hi, 0.9)) / 3
        out += [
            share(a.between(lo, hi)).alias(f"coverage{tail}"), F.avg(loss).alias(f"pinball{tail}"), share(a < lo).alias(f"below{tail}"),
            share(a > hi).alias(f"above{tail}")
        ]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *out)
