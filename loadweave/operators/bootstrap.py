"""Block bootstraps with hash draws: replicate r's k-th block is a hash of (seed, r, k) modulo the
number of blocks, so draws need no random state and any partitioning gives the same numbers. The hash is
plain arithmetic that any SQL engine can repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mix(x: Column) -> Column:
    """A 32-bit value, its bits stirred."""
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * 73244475) % 4294967296
    return x.bitwiseXOR(F.shiftright(x, 16))


def draw(seed: int, rep: Column, k: Column, n: Column) -> Column:
    """The block, 0 to n - 1, that replicate rep takes as its k-th."""
    start = _mix((rep.cast("long") + seed * 1000) % 4294967296)
    return _mix((start + k.cast("long") * 7919) % 4294967296) % n


def block_sums(daily: DataFrame, by: Sequence[str], order: str, value: Sequence[str], length: int) -> DataFrame:
    """(by, block, sums, days): consecutive blocks of `length` positions from 0; the last may be short."""
    return daily.groupBy(*by, F.floor(F.col(order) / length).cast("long").alias("block")).agg(*(F.sum(v).alias(v) for v in value), F.count("*").alias("days"))


def _draw(blocks: DataFrame, by: Sequence[str], value: Sequence[str], n: int, seed: int) -> DataFrame:
    """(by, rep, value sums): a series' block sums are one array, which each replicate draws from."""
    x = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("block", *value))).alias("s"))
    x = x.select(*by, "s", F.size("s").cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rep"))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("b") - 1), lambda k: draw(seed, F.col("rep"), k, F.col("b")).cast("int"))
    x = x.withColumn("places", places)
    total = lambda v: F.aggregate("places", F.lit(0.0), lambda a, i: a + F.get(F.col(f"s.{v}"), i))
    return x.select(*by, "rep", *(total(v).alias(v) for v in value))


def band(
    daily: DataFrame, by: Sequence[str], value: str, order: str = "day_idx", length: int = 7, n: int = 1000, seed: int = 7,
    levels: Sequence[float] = (0.1, 0.5, 0.9)
) -> DataFrame:
    """Percentiles, population standard deviation and share above 0 of the resampled total."""
    reps = _draw(block_sums(daily, by, order, [value], length), by, [value], n, seed)
    q = F.percentile(value, F.array(*(F.lit(x) for x in levels)))
    return reps.groupBy(*by).agg(
        *(q[i].alias(f"p{round(100 * x):02d}") for i, x in enumerate(levels)), F.stddev_pop(value).alias("std"), F.avg((F.col(value) > 0).cast("double")).alias("p_positive")
    )


def skill_interval(
    daily: DataFrame, by: Sequence[str], model: str, reference: str, order: str = "day_idx", length: int = 1, n: int = 1000, seed: int = 7,
    least: int = 3
) -> DataFrame:
    """Paired: the same days are drawn for both errors. Skill percent with its 95 % interval, probability
    of being better and days won."""
    x = daily.na.drop(subset=[model, reference]).where(~F.isnan(model) & ~F.isnan(reference))
    point = x.groupBy(*by).agg(
        F.count("*").alias("n_days"),
        (100 * (1 - F.try_divide(F.sum(model), F.sum(reference)))).alias("skill"),
        F.sum((F.col(model) < F.col(reference)).cast("long")).alias("days_won"),
    ).where(F.col("n_days") >= least)
    reps = _draw(block_sums(x, by, order, [model, reference], length), by, [model, reference], n, seed)
    reps = reps.withColumn("s", 100 * (1 - F.try_divide(F.col(model), F.col(reference))))
    q = F.percentile("s", F.array(F.lit(0.025), F.lit(0.975)))
    ci = reps.groupBy(*by).agg(q[0].alias("ci_low"), q[1].alias("ci_high"), F.avg((F.col("s") > 0).cast("double")).alias("p_better"))
    return point.join(ci, list(by))


def difference_interval(daily: DataFrame, by: Sequence[str], champion: str, variant: str, **options) -> DataFrame:
    """Relative improvement of a variant over the champion, with its interval."""
    return skill_interval(daily, by, variant, champion, **options).withColumnRenamed("skill", "improvement")
