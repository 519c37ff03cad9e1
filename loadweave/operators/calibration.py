"""Online calibration of bands and point forecasts; every window ends before the day it serves.

Rows are (series_id, day, hour, actual, p10, p50, p90). What a row says for each value of a search
grid is summed up per day first; a window then adds the sums of its days, so no row is copied for the
days it serves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import array_quantile, order_statistic


def grid(low: float, high: float, n: int) -> Column:
    """n evenly spaced numbers, as an array column."""
    return F.array(*(F.lit(low + (high - low) * i / (n - 1)) for i in range(n)))


def _before(window: int):
    """The `window` days before each day of a series."""
    return W.partitionBy("series_id").orderBy("day").rangeBetween(-window, -1)


def _history(rows: DataFrame, window: int, least: int) -> DataFrame:
    """Each day with the rows of the `window` days before it, where at least `least` days exist. Days
    are spread over the days they serve by explode, so the join is by key and not a range join."""
    served = rows.withColumn("for_day", F.explode(F.sequence(F.col("day") + 1, F.col("day") + window)))
    days = rows.select("series_id", F.col("day").alias("for_day")).distinct()
    x = served.join(days, ["series_id", "for_day"])
    enough = x.groupBy("series_id", "for_day").agg(F.count_distinct("day").alias("k")).where(F.col("k") >= least).select("series_id", "for_day")
    return x.join(enough, ["series_id", "for_day"], "left_semi")


def _best_on_grid(rows: DataFrame, tests: dict[str, tuple[Callable[[Column], Column], float]], window: int, least: int, points: Column, n: int) -> DataFrame:
    """(series_id, day, name of each test): the grid point at which the share of a window's rows that pass the test
    is nearest its target, the smallest on ties; null where history is short. A test passes on one stretch of
    the grid (or nowhere), so a row is its two ends and a day is n counts."""
    past = _passed_daily(rows, tests, points, n)
    w = _before(window)
    past = past.select("series_id", "day", F.count("*").over(w).alias("days"), F.sum("n").over(w).alias("n"), *(F.collect_list(k).over(w).alias(k) for k in tests))
    return past.select("series_id", "day", *(_best(k, target, points, least).alias(k) for k, (_, target) in tests.items()))


def _passed_daily(rows: DataFrame, tests: dict[str, tuple[Callable[[Column], Column], float]], points: Column, n: int) -> DataFrame:
    """(series_id, day, n, name of each test): the whole rows of a day, and how many of them pass at each grid point."""
    flags = {k: F.transform(points, test) for k, (test, _) in tests.items()}
    ends = lambda f: F.struct(F.array_position(f, True).alias("a"), (n + 1 - F.array_position(F.reverse(f), True)).alias("z"))
    whole = F.col("actual").isNotNull() & F.col("p10").isNotNull() & F.col("p50").isNotNull() & F.col("p90").isNotNull()
    daily = rows.groupBy("series_id", "day").agg(F.count_if(whole).alias("n"), *(F.collect_list(F.when(whole, ends(f))).alias(k) for k, f in flags.items()))
    place = F.sequence(F.lit(1), F.lit(n))

    def passed(k: str) -> Column:
        return F.transform(place, lambda p: F.size(F.filter(k, lambda x: (x["a"] > 0) & (x["a"] <= p) & (p <= x["z"]))))

    return daily.withColumns({k: passed(k) for k in tests})


def _best(k: str, target: float, points: Column, least: int) -> Column:
    """The grid point whose share of n rows, of the days listed in column k, is nearest the target."""
    share = lambda i: F.aggregate(k, F.lit(0), lambda total, day: total + day[i]) / F.col("n")
    scored = F.transform(points, lambda s, i: F.struct(F.round(F.abs(share(i) - target), 12).alias("miss"), s.alias("s")))
    return F.when((F.col("days") >= least) & (F.col("n") > 0), F.array_min(scored)["s"])


def _shrunk(s: Column, shrink: float) -> Column:
    return F.coalesce(1 + shrink * (s - 1), F.lit(1.0))


def _low_edge(s: Column) -> Column:
    return F.col("p50") - s * (F.col("p50") - F.col("p10"))


def _high_edge(s: Column) -> Column:
    return F.col("p50") + s * (F.col("p90") - F.col("p50"))


def rolling_scale(
    rows: DataFrame, window: int = 28, target: float = 0.8, shrink: float = 0.5, least: int = 14, low: float = 0.3, high: float = 3.0,
    n: int = 136
) -> DataFrame:
    """(series_id, day, scale): the factor on both band halves whose coverage was nearest the target,
    smaller factors first, shrunk toward 1; 1 where history is short. Rows with a missing value don't count."""
    inside = lambda s: F.col("actual").between(_low_edge(s), _high_edge(s))
    best = _best_on_grid(rows, {"s": (inside, target)}, window, least, grid(low, high, n), n)
    return best.select("series_id", "day", _shrunk(F.col("s"), shrink).alias("scale"))


def next_scale(
    rows: DataFrame, window: int = 28, target: float = 0.8, shrink: float = 0.5, least: int = 14, low: float = 0.3, high: float = 3.0,
    n: int = 136
) -> DataFrame:
    """(series_id, scale) that rolling_scale() would give the day `next` (a column, one value a series) of which
    there are no rows yet: sums of the days of its window, so that no blank day is appended."""
    inside = lambda s: F.col("actual").between(_low_edge(s), _high_edge(s))
    points = grid(low, high, n)
    recent = rows.where((F.col("day") >= F.col("next") - window) & (F.col("day") < F.col("next")))
    daily = _passed_daily(recent, {"s": (inside, target)}, points, n)
    past = daily.groupBy("series_id").agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.collect_list("s").alias("s"))
    return past.select("series_id", _shrunk(_best("s", target, points, least), shrink).alias("scale"))


def rolling_tail_scales(
    rows: DataFrame, window: int = 28, tail: float = 0.1, shrink: float = 0.5, least: int = 14, low: float = 0.3, high: float = 3.0,
    n: int = 136
) -> DataFrame:
    """(series_id, day, scale_low, scale_high): each band half by its own tail share."""
    tests = {"lo": (lambda s: F.col("actual") < _low_edge(s), tail), "hi": (lambda s: F.col("actual") > _high_edge(s), tail)}
    best = _best_on_grid(rows, tests, window, least, grid(low, high, n), n)
    return best.select("series_id", "day", _shrunk(F.col("lo"), shrink).alias("scale_low"), _shrunk(F.col("hi"), shrink).alias("scale_high"))


def apply_scales(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Bands scaled around p50 by scale, or by scale_low and scale_high."""
    lo, hi = ("scale", "scale") if "scale" in scales.columns else ("scale_low", "scale_high")
    x = rows.join(scales, ["series_id", "day"])
    p50 = F.col("p50")
    return x.withColumns({"p10": p50 - F.col(lo) * (p50 - F.col("p10")), "p90": p50 + F.col(hi) * (F.col("p90") - p50)})


def _feedback_daily(rows: DataFrame, rho_max: float, n: int) -> tuple[DataFrame, DataFrame]:
    """rows with residual and before (that of the day before, at the hour), and per day the pairs and the summed error of each
    of the n factors from 0 to rho_max."""
    hour = W.partitionBy("series_id", "hour").orderBy("day")
    x = rows.withColumn("residual", F.col("actual") - F.col("p50")).withColumn("before", F.lag("residual").over(hour))
    miss = F.col("residual") - F.col("before")  # not null where both are
    errors = (F.sum(F.abs(F.col("residual") - rho_max * i / (n - 1) * F.col("before"))).alias(f"m{i}") for i in range(n))
    return x, x.groupBy("series_id", "day").agg(F.count(miss).alias("n"), *errors)


def _best_rho(rho_max: float, n: int, least: int) -> Column:
    mae = (F.struct(F.round(F.col(f"m{i}") / F.col("n"), 9).alias("mae"), F.lit(rho_max * i / (n - 1)).alias("r")) for i in range(n))
    return F.when((F.col("days") >= least) & (F.col("n") > 0), F.array_min(F.array(*mae))["r"])


def next_feedback(rows: DataFrame, window: int = 28, shrink: float = 0.5, least: int = 14, rho_max: float = 0.8, n: int = 17) -> DataFrame:
    """(series_id, hour, rho, residual): what residual_feedback() would find for the day `next` (a column, one value a
    series) of which there are no rows yet: rho from the sums of its window's days, and the last residual at the hour,
    null where it is not known. rho is 0 before `least` days."""
    x, daily = _feedback_daily(rows, rho_max, n)
    ends = rows.groupBy("series_id").agg(F.max("next").alias("next"))
    recent = daily.join(ends, "series_id").where((F.col("day") >= F.col("next") - window) & (F.col("day") < F.col("next")))
    past = recent.groupBy("series_id").agg(F.count("*").alias("days"), F.sum("n").alias("n"), *(F.sum(f"m{i}").alias(f"m{i}") for i in range(n)))
    tuned = past.select("series_id", (shrink * F.coalesce(_best_rho(rho_max, n, least), F.lit(0.0))).alias("rho"))
    return x.groupBy("series_id", "hour").agg(F.max_by("residual", "day").alias("residual")).join(tuned, "series_id").select("series_id", "hour", "rho", "residual")


def residual_feedback(rows: DataFrame, window: int = 28, shrink: float = 0.5, least: int = 14, rho_max: float = 0.8, n: int = 17) -> DataFrame:
    """(series_id, day, hour, rho, delta, corrected): yesterday's residual at the hour, times the rho that
    was best over the window (smallest on ties), shrunk; rho is 0 before `least` days. The first day
    has no delta and, as it has no day before it, no part in the choice."""
    x, daily = _feedback_daily(rows, rho_max, n)
    w = _before(window)
    past = daily.select("series_id", "day", F.count("*").over(w).alias("days"), F.sum("n").over(w).alias("n"), *(F.sum(f"m{i}").over(w).alias(f"m{i}") for i in range(n)))
    tuned = past.select("series_id", "day", _best_rho(rho_max, n, least).alias("r"))
    out = x.join(tuned, ["series_id", "day"], "left").withColumn("rho", shrink * F.coalesce("r", F.lit(0.0)))
    delta = F.coalesce(F.col("rho") * F.col("before"), F.lit(0.0))
    return out.withColumn("delta", delta).withColumn("corrected", F.col("p50") + F.col("delta")).select("series_id", "day", "hour", "rho", "delta", "corrected")


def intraday(rows: DataFrame, now_hour: int, shrink: float = 0.5, half_life: float = 3.0, least: int = 1) -> DataFrame:
    """(series_id, day, hour, actual, p10, p50, p90) -> shift and moved bands for hours from now_hour on:
    recent residuals of the day weighted by age, valid hours only; no shift below `least` hours."""
    seen = rows.where((F.col("hour") < now_hour) & F.col("actual").isNotNull())
    w = F.pow(F.lit(0.5), (now_hour - 1 - F.col("hour")) / half_life)
    d = seen.groupBy("series_id", "day").agg(F.sum(w * (F.col("actual") - F.col("p50"))).alias("wr"), F.sum(w).alias("w"), F.count("*").alias("k"))
    d = d.select("series_id", "day", F.when(F.col("k") >= least, shrink * F.try_divide("wr", "w")).alias("shift"))
    x = rows.where(F.col("hour") >= now_hour).join(d, ["series_id", "day"], "left").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    return x.withColumns({c: F.col(c) + F.col("shift") for c in ("p10", "p50", "p90")})


# --- conformal ----------------------------------------------------------------------------------
def conformal_offset(scores: DataFrame, by: list[str], score: str, alpha: float = 0.2) -> DataFrame:
    """Interpolated quantile of the scores at (1 - alpha)(1 + 1/n), at most 1. May be negative."""
    x = scores.groupBy(*by).agg(F.array_sort(F.collect_list(score)).alias("s"))
    level = F.least(F.lit(1.0), (1 - alpha) * (1 + 1 / F.size("s")))
    return x.select(*by, array_quantile("s", level).alias("offset"), F.size("s").alias("n"))


def order_statistic_offset(scores: DataFrame, by: list[str], score: str, coverage: float = 0.8) -> DataFrame:
    """The ceil((n + 1) coverage)-th smallest score, at least 0."""
    x = scores.groupBy(*by).agg(F.array_sort(F.collect_list(score)).alias("s"))
    return x.select(*by, order_statistic("s", coverage).alias("offset"), F.size("s").alias("n"))


def higher_quantile(scores: DataFrame, by: list[str], score: str, level: float) -> DataFrame:
    """The upper of the two neighbours of the quantile's position."""
    x = scores.groupBy(*by).agg(F.array_sort(F.collect_list(score)).alias("s"))
    k = F.ceil((F.size("s") - 1) * level - 1e-12).cast("int") + 1
    return x.select(*by, F.element_at("s", k).alias("offset"), F.size("s").alias("n"))


def cqr_score(actual: str = "actual", low: str = "p10", high: str = "p90") -> Column:
    """How far the actual value is outside the band; negative inside."""
    return F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high))


def cqr_interp(calibration: DataFrame, by: list[str], alpha: float = 0.2) -> DataFrame:
    return conformal_offset(calibration.withColumn("score", cqr_score()), by, "score", alpha)


def cqr_orderstat(calibration: DataFrame, by: list[str], coverage: float = 0.8) -> DataFrame:
    return order_statistic_offset(calibration.withColumn("score", cqr_score()), by, "score", coverage)


def widen(rows: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    """Bands moved out by the offset, kept in order around p50."""
    x = rows.join(offsets.select(*by, "offset"), by)
    return x.withColumns({"p10": F.least("p50", F.col("p10") - F.col("offset")), "p90": F.greatest("p50", F.col("p90") + F.col("offset"))})


def rolling_conformal(rows: DataFrame, window: int = 28, alpha: float = 0.2, least: int = 7, per_hour: bool = False) -> DataFrame:
    """Offset of each day from the absolute residuals of the days before it, pooled or by hour."""
    by = ["series_id", "for_day", *(["hour"] if per_hour else [])]
    x = _history(rows.withColumn("score", F.abs(F.col("actual") - F.col("p50"))), window, least)
    return conformal_offset(x, by, "score", alpha).withColumnRenamed("for_day", "day")


def online_level(daily: DataFrame, target: float = 0.8, step: float = 0.05, top: float = 0.995) -> DataFrame:
    """(series_id, day, covered share) -> eta used on each day: raised after a day that covered too little,
    lowered after one that covered too much, inside [target, top]. A bounded fold per series."""
    x = daily.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("day", "covered"))).alias("d"))
    zero = F.struct(F.lit(target).alias("eta"), F.expr("cast(array() as array<struct<day:int,eta:double>>)").alias("out"))
    clip = lambda v: F.greatest(F.lit(target), F.least(F.lit(top), v))
    fold = F.aggregate(
        "d",
        zero,
        lambda acc, r: F.struct(
            clip(acc["eta"] + step * (target - r["covered"])).alias("eta"), F.concat(acc["out"], F.array(F.struct(r["day"].cast("int").alias("day"), acc["eta"].alias("eta")))).alias("out")
        ),
        lambda acc: acc["out"],
    )
    return x.select("series_id", F.explode(fold).alias("r")).select("series_id", "r.day", "r.eta")


def target_alpha(validation: DataFrame, by: list[str], target: float = 0.8, alpha: float = 0.2, factors=(1.0, 0.7, 0.5, 0.35, 0.25)) -> DataFrame:
    """(by, half, score) with half 'fit' or 'check': the first alpha of the list whose offset, fitted on one
    half, covers the target on the other; the last one if none does."""
    fit = validation.where("half = 'fit'").groupBy(*by).agg(F.array_sort(F.collect_list("score")).alias("s"))
    tries = fit.select(*by, "s", F.posexplode(F.array(*(F.lit(alpha * f) for f in factors))).alias("k", "alpha"))
    tries = tries.select(*by, "k", "alpha", array_quantile("s", F.least(F.lit(1.0), (1 - F.col("alpha")) * (1 + 1 / F.size("s")))).alias("offset"))
    seen = validation.where("half = 'check'").join(tries, by).groupBy(*by, "k").agg(
        F.first("alpha").alias("alpha"), F.first("offset").alias("offset"), F.avg((F.col("score") <= F.col("offset")).cast("double")).alias("coverage")
    )
    rank = F.when(F.col("coverage") >= target, F.col("k")).otherwise(100 - F.col("k"))
    return seen.groupBy(*by).agg(F.min_by(F.struct("alpha", "offset", "coverage"), rank).alias("r")).select(*by, "r.*")
