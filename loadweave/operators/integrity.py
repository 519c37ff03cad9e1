"""Integrity of series: gaps, point checks, frozen runs, imputation, validation gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite, local_time


def per_series():
    return W.partitionBy("series_id")


def in_order():
    return per_series().orderBy("ts")


def gaps(series: DataFrame, step_s: int = 3600) -> DataFrame:
    """Steps longer than step_s: (series_id, gap_start, gap_end, missing_slots)."""
    x = series.select("series_id", "ts").distinct().withColumn("before", F.lag("ts").over(in_order()))
    seconds = F.unix_timestamp("ts") - F.unix_timestamp("before")
    missing = F.greatest(F.floor(seconds / step_s) - 1, F.lit(0))
    return x.where(seconds > step_s).select("series_id", F.col("before").alias("gap_start"), F.col("ts").alias("gap_end"), missing.cast("long").alias("missing_slots"))


def integrity_report(series: DataFrame, step_s: int = 3600, zone: str = "UTC", partial_edges: bool = True) -> DataFrame:
    """One row per series: rows, duplicate times, non-finite values, gaps, missing slots and local days
    whose number of times differs from the 23, 24 or 25 hours they have. Edge days may be partial."""
    base = series.groupBy("series_id").agg(
        F.count("*").alias("n"),
        (F.count("*") - F.count_distinct("ts")).alias("n_duplicates"),
        F.sum(finite("value").isNull().cast("long")).alias("n_not_finite"),
    )
    g = gaps(series, step_s).groupBy("series_id").agg(F.count("*").alias("n_gaps"), F.sum("missing_slots").alias("missing_slots"))
    days = series.select("series_id", "ts").distinct().groupBy("series_id", F.to_date(local_time("ts", zone)).alias("d")).agg(F.count("*").alias("k"))
    start, end = (F.to_utc_timestamp(x.cast("timestamp"), zone) for x in (F.col("d"), F.date_add("d", 1)))
    expected = ((F.unix_timestamp(end) - F.unix_timestamp(start)) / step_s).cast("long")
    edge = (F.col("d") == F.min("d").over(per_series())) | (F.col("d") == F.max("d").over(per_series()))
    odd = days.withColumn("odd", (F.col("k") != expected) & (~edge if partial_edges else F.lit(True)))
    odd = odd.groupBy("series_id").agg(F.sum(F.col("odd").cast("long")).alias("n_odd_days"))
    zero = F.lit(0).cast("long")
    out = base.join(g, "series_id", "left").join(odd, "series_id", "left")
    return out.select("series_id", "n", "n_duplicates", "n_not_finite", *(F.coalesce(c, zero).alias(c) for c in ("n_gaps", "missing_slots", "n_odd_days")))


def point_checks(series: DataFrame, mad_k: float = 8.0, allow_negative: bool = False, max_plausible: float | None = None) -> DataFrame:
    """Adds the array `issues` (missing, negative, too_high, outlier) and `good` (no issue). Outlier: beyond
    mad_k times 1.4826 MAD from the median; not judged if that scale is nothing."""
    value = finite("value")
    x = series.withColumn("value", value)
    med = x.groupBy("series_id").agg(F.median("value").alias("med"))
    x = x.join(med, "series_id")
    mad = x.groupBy("series_id").agg((F.median(F.abs(F.col("value") - F.col("med"))) * 1.4826).alias("sigma"))
    x = x.join(mad, "series_id")
    v = F.col("value")
    tests = {
        "missing": v.isNull(),
        "negative": (v < 0) & F.lit(not allow_negative),
        "too_high": v > F.lit(max_plausible) if max_plausible is not None else F.lit(False),
        "outlier": (F.col("sigma") > 1e-12) & (F.abs(v - F.col("med")) > mad_k * F.col("sigma")),
    }
    issues = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))
    return x.withColumn("issues", issues).withColumn("good", F.size("issues") == 0)


def frozen_runs(series: DataFrame, run: int = 6) -> DataFrame:
    """Runs of at least `run` equal consecutive values: (series_id, run_start, run_end, length, value)."""
    change = F.when(F.col("value") == F.lag("value").over(in_order()), 0).otherwise(1)
    x = series.withColumn("change", change).withColumn("run_id", F.sum("change").over(in_order()))
    return (
        x.where("value is not null")
        .groupBy("series_id", "run_id")
        .agg(F.min("ts").alias("run_start"), F.max("ts").alias("run_end"), F.count("*").alias("length"), F.first("value").alias("value"))
        .where(F.col("length") >= run)
        .drop("run_id")
    )


def impute(checked: DataFrame, period: int = 24, longest: int = 2) -> DataFrame:
    """(series_id, ts, value, good) on an even time axis -> adds filled and method. A bad place takes the
    first good value 1, 2, 3 periods before or after; else, in gaps of up to `longest`, the line
    between its good neighbours; else the median of good values within a period; else nothing.
    Only original good values count. Values are rounded to 4 digits."""
    x = checked.withColumn("ok", F.when(F.col("good"), F.col("value"))).withColumn("i", F.row_number().over(in_order()))
    shifts = [f(F.col("ok"), k * period).over(in_order()) for k in (1, 2, 3) for f in (F.lag, F.lead)]
    before = in_order().rowsBetween(W.unboundedPreceding, -1)
    after = in_order().rowsBetween(1, W.unboundedFollowing)
    mark = F.when(F.col("ok").isNotNull(), F.struct("i", "ok"))
    x = x.withColumn("p", F.last(mark, ignorenulls=True).over(before)).withColumn("q", F.first(mark, ignorenulls=True).over(after))
    gap = F.col("q.i") - F.col("p.i")
    line = F.when(gap - 1 <= longest, F.col("p.ok") + (F.col("q.ok") - F.col("p.ok")) * (F.col("i") - F.col("p.i")) / gap)
    near = F.percentile("ok", 0.5).over(in_order().rowsBetween(-period, period))
    x = x.withColumn("seasonal", F.coalesce(*shifts)).withColumn("line", line).withColumn("near", near)
    filled = F.when(F.col("good"), F.col("value")).otherwise(F.round(F.coalesce("seasonal", "line", "near"), 4))
    method = (
        F.when(F.col("good"), "kept")
        .when(F.col("seasonal").isNotNull(), "seasonal")
        .when(F.col("line").isNotNull(), "line")
        .when(F.col("near").isNotNull(), "median")
        .otherwise("unreplaceable")
    )
    return x.withColumn("filled", filled).withColumn("method", method).drop("ok", "i", "p", "q", "seasonal", "line", "near")


def validate(series: DataFrame, **checks) -> DataFrame:
    """The gate: a series is replaced by its filled values only if something was filled and nothing
    was unreplaceable; else it passes as it is. Adds applied and issue counts."""
    x = impute(point_checks(series, **checks))
    n_filled = F.sum((~F.col("method").isin("kept", "unreplaceable")).cast("long")).over(per_series())
    n_left = F.sum((F.col("method") == "unreplaceable").cast("long")).over(per_series())
    x = x.withColumn("n_filled", n_filled).withColumn("n_left", n_left).withColumn("applied", (F.col("n_filled") > 0) & (F.col("n_left") == 0))
    return x.withColumn("clean", F.when(F.col("applied"), F.col("filled")).otherwise(F.col("value"))).select("series_id", "ts", "value", "clean", "applied", "n_filled", "n_left", "issues")


def issue_samples(checked: DataFrame, most: int = 20) -> DataFrame:
    """The first issues of each series: the feature is a short list."""
    x = checked.where(~F.col("good")).withColumn("k", F.row_number().over(in_order()))
    return x.where(F.col("k") <= most).select("series_id", "ts", "value", "issues")
