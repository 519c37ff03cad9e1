"""Streams of meter readings: hourly aggregation with late data, and stateful online corrections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly(readings: DataFrame, late: str | None = "2 hours") -> DataFrame:
    """(series_id, ts, value) -> hourly means; readings later than `late` behind the newest are dropped.
    None keeps the watermark that the stream has, e.g. from dedup()."""
    w = (readings if late is None else readings.withWatermark("ts", late)).groupBy(F.window("ts", "1 hour"), "series_id")
    return w.agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("series_id", F.col("window.start").alias("ts"), "value", "n")


def dedup(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """One reading per series and time, the first to arrive."""
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series_id", "ts"])


def online_shift(pairs: DataFrame, shrink: float = 0.5, half_life: float = 3.0) -> DataFrame:
    """(series_id, day, hour, p50, actual) as they arrive -> the shift for the day's remaining hours after each
    batch. State per series is the day and two running sums, whatever the stream's length."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, weighted, weight, last = state.get if state.exists else (-1, 0.0, 0.0, -1)
        for pdf in batches:
            for row in pdf.sort_values(["day", "hour"]).itertuples():
                if row.day < day or pd.isna(row.actual):
                    continue  # an older day can't change today's shift
                if row.day > day:
                    day, weighted, weight, last = int(row.day), 0.0, 0.0, -1
                w = 0.5 ** (max(0, row.hour - last) / half_life) if last >= 0 else 1.0
                if row.hour >= last:
                    weighted, weight, last = weighted * w + (row.actual - row.p50), weight * w + 1.0, int(row.hour)
                else:  # late inside the day: it counts with its age
                    age = 0.5 ** ((last - row.hour) / half_life)
                    weighted, weight = weighted + age * (row.actual - row.p50), weight + age
        state.update((day, weighted, weight, last))
        if weight:
            yield pd.DataFrame({"series_id": [key[0]], "day": [day], "last_hour": [last], "shift": [shrink * weighted / weight]})

    return pairs.groupBy("series_id").applyInPandasWithState(
        update,
        "series_id string, day int, last_hour int, shift double",
        "day int, weighted double, weight double, last int",
        "update",
        GroupStateTimeout.NoTimeout,
    )
