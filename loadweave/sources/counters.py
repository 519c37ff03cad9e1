"""Cumulative meters: wide or long counters to power."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unpivot(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ts, one column per counter) -> (series_id, ts, value)."""
    return wide.unpivot(["ts"], list(columns), "series_id", "value")


def grid_import(counters: DataFrame, scale: float = 1.0, least_active: int = 1) -> DataFrame:
    """(series_id, ts, cumulative kWh per quarter hour) -> hourly MW over all counters: steps back (resets) are no
    reading, times with fewer than least_active readings go, kWh a quarter hour times 4 is kW."""
    step = F.col("value") - F.lag("value").over(W.partitionBy("series_id").orderBy("ts"))
    x = counters.withColumn("d", F.round(step, 6)).withColumn("d", F.when(F.col("d") >= 0, F.col("d")))
    x = x.groupBy("ts").agg(F.sum("d").alias("kwh"), F.count("d").alias("k")).where(F.col("k") >= least_active)
    power = F.avg(F.col("kwh") * 4 * scale / 1000)
    return x.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(power.alias("value"))


def household_hours(readings: DataFrame, need: int = 4) -> DataFrame:
    """Hourly sums per household where all `need` readings of the hour are there."""
    x = readings.groupBy("household_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("value"), F.count("value").alias("k"))
    return x.where(F.col("k") == need).drop("k")


def candidates(overview: DataFrame, low: str, high: str, least_days: int, most: int) -> DataFrame:
    """Households available over [low, high] with enough days, those with most days first: a top-k report."""
    x = overview.where((F.col("first_day") <= F.lit(low).cast("date")) & (F.col("last_day") >= F.lit(high).cast("date")) & (F.col("days") >= least_days))
    return x.orderBy(F.desc("days"), "household_id").limit(most)


def read_archives(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Lines of the files in zip archives whose names match a regular expression: (archive, entry, line_no, line). An
    archive is a task; its files are read as streams, so no file is held as a whole."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for entry in sorted(z.namelist()):
                        if not re.search(pattern, entry):
                            continue
                        with z.open(entry) as f:
                            held, first = [], 0
                            for line in io.TextIOWrapper(f, "utf-8", "replace"):
                                held.append(line.rstrip("\r\n"))
                                if len(held) == 50_000:
                                    yield pd.DataFrame({"archive": name, "entry": entry, "line_no": range(first, first + len(held)), "line": held})
                                    held, first = [], first + len(held)
                            if held:
                                yield pd.DataFrame({"archive": name, "entry": entry, "line_no": range(first, first + len(held)), "line": held})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, entry string, line_no long, line string")
