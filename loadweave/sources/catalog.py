"""Dataset catalogues and mock series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "key string, name string, path string, ts string, col string, unit string, signed boolean, include_in_benchmark boolean"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON manifest that take part in the benchmark; columns are pinned, never inferred."""
    x = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return x.where(F.coalesce("include_in_benchmark", F.lit(True)))


def qualify(stats: DataFrame) -> DataFrame:
    """(key, samples, days, per_hour, mean, std) -> qualified: by resolution at least 34 000, 17 000 or 8 000
    samples and 300 days; mape_useful: the mean is well away from zero."""
    need = F.when(F.col("per_hour") >= 4, 34_000).when(F.col("per_hour") >= 2, 17_000).otherwise(8_000)
    return stats.withColumn("qualified", (F.col("samples") >= need) & (F.col("days") >= 300)).withColumn("mape_useful", F.abs("mean") > F.col("std") * 0.1)


def cache_views(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> None:
    """Each table as Parquet below root and as a view of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        spark.read.parquet(f"{root}/{name}").createOrReplaceTempView(name)


def synthetic_load(
    spark: SparkSession, days: int, series: int = 1, peak_mw: float = 10.0, residential: float = 0.6, rho: float = 0.7, sigma: float = 0.03,
    seed: int = 1
) -> DataFrame:
    """Mock small utilities: residential and industrial day shapes, weekends, AR(1) noise, scaled to a peak.
    Noise comes from hashes, so it doesn't depend on partitioning; the AR(1) runs over 48 past shocks."""
    h = spark.range(days * 24).select(F.col("id").alias("k")).crossJoin(spark.range(series).select(F.concat(F.lit("s"), F.col("id")).alias("series_id")))
    hour, dow = F.col("k") % 24, F.floor(F.col("k") / 24) % 7

    def shock(lag):
        u = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "series_id", F.col("k") - lag), F.lit(1_000_003)) + 0.5) / 1_000_003
        return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))

    ar = F.aggregate(F.sequence(F.lit(0), F.lit(47)), F.lit(0.0), lambda a, j: a + F.pow(F.lit(rho), j) * shock(j))
    home = 0.55 + 0.25 * F.exp(-F.pow((hour - 19) / 3.0, 2)) + 0.15 * F.exp(-F.pow((hour - 8) / 2.0, 2))
    work = F.when((dow < 5) & hour.between(6, 17), 1.0).otherwise(0.45)
    x = h.withColumn("raw", (residential * home + (1 - residential) * work) * (1 + sigma * ar))
    from pyspark.sql import Window as W

    value = F.col("raw") / F.max("raw").over(W.partitionBy("series_id")) * peak_mw
    return x.select("series_id", F.timestamp_seconds(F.lit(1704067200) + F.col("k") * 3600).alias("ts"), value.alias("value"))


def mock_wind(series: DataFrame, hours: int = 6) -> DataFrame:
    """Rolling mean over the last hours: the smooth mock of a wind series."""
    from pyspark.sql import Window as W

    return series.withColumn("value", F.avg("value").over(W.partitionBy("series_id").orderBy("ts").rowsBetween(1 - hours, 0)))
