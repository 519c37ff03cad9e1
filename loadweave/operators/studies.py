"""Studies that compose other operators: lever grids, cost asymmetry, ensembles, hierarchies, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import features, metrics, models, reconcile, risk
from .relations import _cut, dealt_union


def intraday_levers(rows: DataFrame, hours: Sequence[int] = (6, 9, 12, 15), shrinks: Sequence[float] = (0.25, 0.5, 0.75, 1.0), half_life: float = 3.0) -> DataFrame:
    """(series_id, day, hour, actual, p50) -> per series, kind (mean or ewm), shrink and update hour: error of the rest
    of the day before and after the shift, and the share of days it helps. A constant grid is
    exploded; the rest is two aggregations by day."""
    x = rows.withColumn("r", F.col("actual") - F.col("p50")).where("r is not null")
    x = x.withColumn("update_hour", F.explode(F.array(*(F.lit(h) for h in hours))))
    seen, age = F.col("hour") < F.col("update_hour"), F.pow(F.lit(0.5), (F.col("update_hour") - 1 - F.col("hour")) / half_life)
    shift = x.groupBy("series_id", "day", "update_hour").agg(
        F.avg(F.when(seen, F.col("r"))).alias("mean"), F.try_divide(F.sum(F.when(seen, age * F.col("r"))), F.sum(F.when(seen, age))).alias("ewm")
    )
    shift = shift.unpivot(["series_id", "day", "update_hour"], ["mean", "ewm"], "kind", "delta").where("delta is not null")
    shift = shift.withColumn("shrink", F.explode(F.array(*(F.lit(float(s)) for s in shrinks))))
    rest = x.where(~seen).select("series_id", "day", "update_hour", "r").join(shift, ["series_id", "day", "update_hour"])
    daily = rest.groupBy("series_id", "kind", "shrink", "update_hour", "day").agg(F.avg(F.abs("r")).alias("before"), F.avg(F.abs(F.col("r") - F.col("shrink") * F.col("delta"))).alias("after"))
    return daily.groupBy("series_id", "kind", "shrink", "update_hour").agg(
        F.count("*").alias("n_days"), F.avg("before").alias("mae_before"), F.avg("after").alias("mae_after"), (100 * F.avg((F.col("after") < F.col("before") - 1e-9).cast("double"))).alias("helped")
    )


def asymmetry_costs(rows: DataFrame, ratios: Sequence[float] = (1.0, 1.5, 2.0, 3.0, 5.0), by: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Cost of nominating the median against the cost-optimal quantile as c_short / c_long grows, on the same
    residual scenarios; percent saved."""
    out = []
    for ratio in ratios:
        q = risk.nomination(F.lit(0.0), F.col("residuals"), ratio, 1.0)
        m = risk.nomination(F.lit(0.0), F.col("residuals"), 1.0, 1.0)
        cost = lambda n: risk.expected_cost(F.lit(0.0), F.col("residuals"), n, ratio, 1.0)  # noqa: B023, E731
        out.append(rows.select(*by, cost(m).alias("a"), cost(q).alias("b")).groupBy(*by).agg(F.sum("a").alias("median_cost"), F.sum("b").alias("optimal_cost")).withColumn("ratio", F.lit(float(ratio))))
    return dealt_union(by, *out).withColumn("saved_percent", 100 * (1 - F.try_divide("optimal_cost", "median_cost")))


def generation_bias(days: DataFrame, proxy: str, n_test: int, retrain_every: int = 7, first: int = 7) -> DataFrame:
    """Rolling correction of a physical proxy: ridge (lambda 1) on generation_features, the model of a day is the
    one fitted last on its retraining grid; forecasts don't go below 0."""
    names = ["one", "proxy", "proxy2", "sin_h1", "cos_h1", "sin_h2", "cos_h2", "sin_d1", "cos_d1", "sin_y1", "cos_y1", "sin_y2", "cos_y2"]
    rows = features.generation_features(days, proxy).withColumn("target", F.col("value")).where(F.col("day_idx") >= first)
    rows = models.with_vector(rows, names)
    fitted = models.fit_expanding(rows, n_test, (1.0,), shrunk=False)
    start = F.min("test_day").over(W.partitionBy("series_id"))
    fitted = fitted.withColumn("start", start).where((F.col("test_day") - F.col("start")) % retrain_every == 0)
    served = fitted.withColumn("day_idx", F.explode(F.sequence(F.col("test_day"), F.col("test_day") + retrain_every - 1)))
    x = rows.join(served.select("series_id", "day_idx", "weights"), ["series_id", "day_idx"])
    return x.select("series_id", "day_idx", "hour", F.col("value").alias("actual"), F.greatest(F.lit(0.0), models.dot("x", "weights")).alias("forecast"))


def bagged_intervals(rows: DataFrame, n_models: int = 10, block: int = 7, alpha: float = 0.2, seed: int = 5, n_test: int = 0) -> DataFrame:
    """Block-bootstrapped ridge ensemble: each member sees weekly blocks drawn by hash, the band comes from the
    residuals of the members' mean on the training days, which leave out the last n_test known days. rows are
    models.with_vector() rows."""
    ends = rows.where("target is not null").groupBy("series_id").agg((F.max("day_idx") + 1 - n_test).alias("until"))
    known = rows.where("target is not null").join(ends, "series_id").where("day_idx < until").drop("until")
    blocks = known.select("series_id", F.floor(F.col("day_idx") / block).alias("b")).distinct()
    place = blocks.withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy("b")) - 1).withColumn("n", F.count("*").over(W.partitionBy("series_id")))
    tries = place.select("series_id", F.col("k").alias("slot"), "n", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))).alias("m"))
    drawn = tries.withColumn("k", F.pmod(F.xxhash64(F.lit(seed), "m", "slot"), F.col("n"))).join(place.select("series_id", "k", "b"), ["series_id", "k"])
    # a member is a series of its own; its days are renumbered by slot
    x = known.withColumn("b", F.floor(F.col("day_idx") / block)).join(drawn.select("series_id", "m", "slot", "b"), ["series_id", "b"])
    x = x.select(
        F.concat_ws("#", "series_id", "m").alias("series_id"),
        (F.col("slot") * block + F.col("day_idx") % block).cast("int").alias("day_idx"), "hour", "x", "target"
    )
    fitted = models.fit_expanding(x, 0, (10.0,), shrunk=False).withColumn("series_id", F.substring_index("series_id", "#", 1))
    mean = fitted.select("series_id", F.posexplode("weights").alias("i", "w")).groupBy("series_id", "i").agg(F.avg("w").alias("w"))
    mean = mean.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("s")).select("series_id", F.col("s.w").alias("weights"))
    p = rows.join(mean, "series_id").withColumn("model", F.col("base") + models.dot("x", "weights"))
    p = p.join(ends, "series_id")
    inside = p.where((F.col("day_idx") < F.col("until")) & F.col("value").isNotNull())
    q = F.percentile(F.col("value") - F.col("model"), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    band = inside.groupBy("series_id").agg(q[0].alias("lo"), q[1].alias("hi"))
    return p.where(F.col("day_idx") >= F.col("until") if n_test else F.lit(True)).join(band, "series_id").select(
        "series_id", "day_idx", "hour", F.col("value").alias("actual"), "model", (F.col("model") + F.col("lo")).alias("p10"),
        (F.col("model") + F.col("hi")).alias("p90")
    )


LEVELS = {"day": 1, "hour": 24, "quarter": 96}


def temporal_forecasts(
    quarters: DataFrame, cal_days: int = 28, lams: Sequence[float] = (10.0,), holidays: DataFrame | None = None, min_history: int = 60, first: int = features.FIRST
) -> DataFrame:
    """quarters(series_id, day_idx, local_date, slot, value) -> (tree_id, period, local_date, node_id, level, value, actual): forecasts
    of each day from min_history on, and of the day after the last, made apart at 96, 24 and 1 steps a day from the days before.

    Levels are series of one plan, told apart by key, with as many steps a day as they have: features, fits and predictions of all
    series and levels are each one pass. A day's model is fitted on the days before the last cal_days, as next_day()'s is. Days
    that don't follow their predecessor by the calendar are no targets."""
    whole = quarters.groupBy("series_id", "day_idx", "local_date").agg(F.count("value").alias("n")).where("n = 96").drop("n")
    x = quarters.join(whole, ["series_id", "day_idx", "local_date"])
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("slot") * n / 96).cast("int").alias("hour"), F.lit(n).alias("slots")) for k, n in LEVELS.items())))
    x = x.select("series_id", "day_idx", "local_date", at.alias("at"), "value").select("series_id", "day_idx", "local_date", "at.*", "value")
    # days are numbered anew, as those that aren't whole have gone
    number = F.dense_rank().over(W.partitionBy("series_id").orderBy("local_date")) - 1
    x = x.groupBy("series_id", "local_date", "level", "hour", "slots").agg(F.sum("value").alias("value")).withColumn("day_idx", number.cast("int"))
    days = x.select(F.concat_ws("@", "level", "series_id").alias("series_id"), "day_idx", "local_date", "hour", "slots", "value")
    rows = _cut(models.with_vector(features.features(models.append_days(days), holidays), features.FEATURES))
    cut = lambda d: d - cal_days if d - cal_days > first + 2 else d
    fits = models._fit(rows, lambda new: sorted({cut(d) for d in range(min_history, new + 1)}), lams, True, True)
    fits = fits.select("series_id", F.col("test_day").alias("cut"), "weights")
    cut_of = F.when(F.col("day_idx") - cal_days > first + 2, F.col("day_idx") - cal_days).otherwise(F.col("day_idx"))
    y = rows.where(F.col("day_idx") >= min_history).withColumn("cut", cut_of).join(fits, ["series_id", "cut"])
    level, tree = F.substring_index("series_id", "@", 1), F.expr("substring(series_id, instr(series_id, '@') + 1)")
    node = F.when(level == "day", F.lit("day")).otherwise(F.concat(F.substring(level, 1, 1), F.lpad(F.col("hour").cast("string"), 2, "0")))
    # a target follows the day before it: lag over the days of one step
    before = F.lag("local_date").over(W.partitionBy("series_id", "hour").orderBy("day_idx"))
    seen = days.groupBy("series_id").agg(F.max("day_idx").alias("last"))
    follows = rows.select("series_id", "hour", "day_idx", "local_date", before.alias("before")).where("hour = 0 and (before is null or date_add(before, 1) = local_date)").select("series_id", "day_idx")
    y = y.join(follows, ["series_id", "day_idx"]).join(seen, "series_id")
    return y.select(
        tree.alias("tree_id"), F.col("day_idx").alias("period"), "local_date", node.alias("node_id"), level.alias("level"), (F.col("base") + models.dot("x", "weights")).alias("value"), F.col("value").alias("actual"),
        (F.col("day_idx") > F.col("last")).alias("coming"),
    )


def temporal_reconciliation(quarters: DataFrame, n_test: int = 7, method: str = "wls_struct", residual_days: int = 14, shrink: float = 0.2, **options) -> dict[str, DataFrame]:
    """Forecasts at day, hour and quarter-hour level, made coherent: backtest, one row per series and level over the last n_test
    targets (n, mae and mape of the forecasts before and after, gain in percent, mean coherence gap of a day before and after), and next, the
    coming day's nodes (series_id, local_date, node_id, level, value, reconciled).

    wls_var and mint_shrink use residuals of the residual_days targets before the days that they serve. options go to
    temporal_forecasts()."""
    x = _cut(temporal_forecasts(quarters, **options))
    order = W.partitionBy("tree_id").orderBy(F.desc("period"))
    ranked = x.where("not coming").select("tree_id", "period").distinct().withColumn("k", F.row_number().over(order))
    ranked = _cut(ranked.where(F.col("k") <= n_test + residual_days))
    tree = reconcile.temporal_tree(quarters.sparkSession)
    weighted = method in ("wls_var", "mint_shrink")

    def fixed(base: DataFrame, low: int) -> DataFrame:
        past = x.join(ranked.where((F.col("k") > low) & (F.col("k") <= low + residual_days)), ["tree_id", "period"])
        residuals = past.select("tree_id", F.col("period").alias("t"), "node_id", (F.col("actual") - F.col("value")).alias("residual")) if weighted else None
        return reconcile.reconcile_tree(base, tree, method, residuals, shrink)

    tested = x.join(ranked.where(F.col("k") <= n_test).drop("k"), ["tree_id", "period"])
    after = fixed(tested, n_test).join(tested.select("tree_id", "period", "node_id", "level", "actual"), ["tree_id", "period", "node_id"])
    coming = x.where("coming")
    ahead = fixed(coming, 0).join(coming.select("tree_id", "period", "node_id", "level", "local_date"), ["tree_id", "period", "node_id"])
    return {
        "backtest": level_scores(after, tree).withColumnRenamed("tree_id", "series_id"),
        "next": ahead.select(F.col("tree_id").alias("series_id"), "local_date", "node_id", "level", "value", "reconciled"),
    }


def level_scores(after: DataFrame, tree: DataFrame) -> DataFrame:
    """(tree_id, period, node_id, level, value, reconciled, actual) -> per tree and level: n, mae and mape before and after, gain in
    percent, and the mean gap between nodes and their children's sums before and after (of the whole tree)."""
    after, gaps = _cut(after), None
    for name, c in (("gap_before", "value"), ("gap_after", "reconciled")):
        g = reconcile.incoherence(after.select("tree_id", "period", "node_id", c), tree, ["tree_id", "period"], c).groupBy("tree_id").agg(F.avg("gap").alias(name))
        gaps = g if gaps is None else gaps.join(g, "tree_id")
    a = F.abs("actual")
    e = {"before": F.abs(F.col("value") - F.col("actual")), "after": F.abs(F.col("reconciled") - F.col("actual"))}
    scores = after.groupBy("tree_id", "level").agg(
        F.count("*").alias("n"), *(F.avg(v).alias(f"mae_{k}") for k, v in e.items()), *((100 * F.avg(F.when(a > 1e-12, v / a))).alias(f"mape_{k}") for k, v in e.items())
    )
    gain = F.when(F.col("mae_before") > 0, 100 * (F.col("mae_before") - F.col("mae_after")) / F.col("mae_before")).otherwise(0.0)
    return scores.withColumn("gain_percent", gain).join(gaps, "tree_id")


def sweep_summary(results: DataFrame, by: Sequence[str], value: str, reference: str) -> DataFrame:
    """Over repeated runs: mean, spread, range of a value and how often it beats the reference."""
    return results.groupBy(*by).agg(
        F.count("*").alias("runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg((F.col(value) < F.col(reference)).cast("double")).alias("win_rate"),
    )


def shoot_out(days: DataFrame, candidates: dict[str, dict], n_test: int) -> DataFrame:
    """Daily errors of several rolling_origin() settings side by side: (series_id, day_idx, candidate, mae)."""
    out = []
    for name, options in candidates.items():
        out.append(metrics.daily_mae(models.rolling_origin(days, n_test, **options), ["series_id"], "model").withColumn("candidate", F.lit(name)))
    return dealt_union(["series_id"], *out)


def single_rating(**ratings: float | None) -> float | None:
    """All limits given for an asset must agree within a milliwatt; the one that holds, or None."""
    given = {k: v for k, v in ratings.items() if v is not None}
    if given and max(given.values()) - min(given.values()) > 1e-6:
        raise ValueError(f"ratings disagree: {given}")
    return next(iter(given.values()), None)
