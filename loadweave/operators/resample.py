"""Time axis: resampling, spines, complete days, alignment. Series are (series_id, ts, value) in UTC.

Everything is keyed by series, so many series share one plan; day indices are positions among the
retained days of a series, not calendar differences.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite, local_time
from .relations import dealt_union


def hourly_mean(series: DataFrame) -> DataFrame:
    """Left-closed hours labelled by their start; hours without a value don't appear."""
    return (
        series.select("series_id", F.date_trunc("hour", "ts").alias("ts"), finite("value").alias("value"))
        .groupBy("series_id", "ts")
        .agg(F.avg("value").alias("value"))
        .where("value is not null")
    )


def hourly_sum(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum(finite("value")).alias("value"))


def spine(series: DataFrame, step: str = "1 hour", low: str | None = None, high: str | None = None) -> DataFrame:
    """(series_id, ts) from first to last time of each series; low and high are optional SQL
    expressions over lo and hi, e.g. whole days."""
    bounds = series.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return bounds.select("series_id", F.expr(f"explode(sequence({low or 'lo'}, {high or 'hi'}, interval {step})) as ts"))


def on_spine(series: DataFrame, fill: float | None = None, step: str = "1 hour", low: str | None = None, high: str | None = None) -> DataFrame:
    """Every step of the spine; gaps are null, or `fill`."""
    out = spine(series, step, low, high).join(series.select("series_id", "ts", "value"), ["series_id", "ts"], "left")
    return out if fill is None else out.withColumn("value", F.coalesce("value", F.lit(fill)))


def whole_days(series: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Hourly spine from midnight of the first to 23:00 of the last day."""
    return on_spine(series, fill, low="date_trunc('day', lo)", high="date_trunc('day', hi) + interval 23 hours")


def daily_matrix(hourly: DataFrame, zone: str = "UTC") -> DataFrame:
    """(series_id, day_idx, local_date, hour, value): local dates with exactly the hours 0 to 23 once
    each; 23- and 25-hour days and days with a gap go. day_idx counts the days that stay."""
    local = local_time("ts", zone)
    x = hourly.where("value is not null").select("series_id", F.to_date(local).alias("local_date"), F.hour(local).alias("hour"), "value")
    day = W.partitionBy("series_id", "local_date")
    x = x.withColumn("n", F.count("*").over(day)).withColumn("hours", F.size(F.collect_set("hour").over(day)))
    index = F.dense_rank().over(W.partitionBy("series_id").orderBy("local_date")) - 1
    return x.where("n = 24 and hours = 24").select("series_id", index.alias("day_idx"), "local_date", "hour", "value")


def contiguous_blocks(hourly: DataFrame) -> DataFrame:
    """24-hour blocks by position from the first sample; the rest after the last whole block goes.
    A series whose steps aren't all one hour gets no rows."""
    order = W.partitionBy("series_id").orderBy("ts")
    every = W.partitionBy("series_id")
    step = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order))
    x = hourly.withColumn("i", F.row_number().over(order) - 1).withColumn("step", step)
    x = x.withColumn("even", F.min(F.coalesce(F.col("step") == 3600, F.lit(True))).over(every)).withColumn("n", F.count("*").over(every))
    x = x.where("even and i < n - n % 24").withColumn("day_idx", F.expr("cast(i div 24 as int)"))
    start = F.min("ts").over(W.partitionBy("series_id", "day_idx"))
    return x.select("series_id", "day_idx", F.to_date(start).alias("local_date"), (F.col("i") % 24).cast("int").alias("hour"), "value")


def quarter_hour_matrix(quarters: DataFrame, zone: str = "UTC", min_days: int = 1) -> DataFrame:
    """(series_id, day_idx, local_date, slot, value) from period-END stamps: each moves back 15 minutes;
    days with exactly the 96 slots stay, series with fewer than min_days of them go."""
    local = local_time(F.col("ts") - F.expr("interval 15 minutes"), zone)
    x = quarters.where("value is not null").select(
        "series_id", F.to_date(local).alias("local_date"), (F.hour(local) * 4 + F.floor(F.minute(local) / 15)).cast("int").alias("slot"), "value"
    )
    day = W.partitionBy("series_id", "local_date")
    x = x.withColumn("n", F.count("*").over(day)).withColumn("slots", F.size(F.collect_set("slot").over(day))).where("n = 96 and slots = 96")
    x = x.withColumn("day_idx", F.dense_rank().over(W.partitionBy("series_id").orderBy("local_date")) - 1)
    x = x.withColumn("days", F.max("day_idx").over(W.partitionBy("series_id")) + 1)
    return x.where(F.col("days") >= min_days).select("series_id", "day_idx", "local_date", "slot", "value")


def temporal_levels(fine: DataFrame, levels: Sequence[Sequence[str]], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Sums of value for several column sets at once; columns outside a set are null. `level` numbers the sets."""
    names = list(dict.fromkeys(c for s in levels for c in s))
    sets = [[F.col(c) for c in (*keys, *s)] for s in levels]
    grouped = fine.groupingSets(sets, *(F.col(c) for c in (*keys, *names))).agg(F.sum("value").alias("value"), F.grouping_id().alias("gid"))
    total = len(keys) + len(names)
    bits = {sum(1 << (total - 1 - len(keys) - i) for i, c in enumerate(names) if c not in s): k for k, s in enumerate(levels)}
    level = F.coalesce(*(F.when(F.col("gid") == b, F.lit(k)) for b, k in bits.items()))
    return grouped.select(*keys, *names, level.alias("level"), "value")


def as_of(left: DataFrame, right: DataFrame, value: str = "value", keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Each row of left (keys, ts, ...) with the last non-null `value` of right at or before its ts, as
    asof_<value>; one shuffle by key, no non-equi join."""
    names = left.columns
    a = left.select(F.struct(*names).alias("row"), *keys, "ts", F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(1).alias("side"))
    b = right.select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), *keys, "ts", F.col(value).alias("v"), F.lit(0).alias("side"))
    last = F.last("v", ignorenulls=True).over(W.partitionBy(*keys).orderBy("ts", "side").rowsBetween(W.unboundedPreceding, 0))
    return dealt_union(keys, b, a).withColumn("found", last).where("side = 1").select("row.*", F.col("found").alias(f"asof_{value}"))


def unmatched_leading(aligned: DataFrame, value: str) -> DataFrame:
    """Rows an as_of() left without a value: those before the first value of their key."""
    return aligned.where(F.col(value).isNull())


def sum_where_all(series: DataFrame, n_series: int, group: Sequence[str] = ("ts",)) -> DataFrame:
    """Sum across series at times where all n_series have a value."""
    return series.groupBy(*group).agg(F.sum("value").alias("value"), F.count("value").alias("n")).where(F.col("n") == n_series).drop("n")


def total_where(series: DataFrame, least: int = 1, group: Sequence[str] = ("ts",)) -> DataFrame:
    """Sum across series at each time, null where fewer than `least` have a value."""
    x = series.groupBy(*group).agg(F.sum("value").alias("value"), F.count("value").alias("n"))
    return x.select(*group, F.when(F.col("n") >= least, F.col("value")).alias("value"))


def stacked(*frames: DataFrame) -> DataFrame:
    """Series frames below each other by column name; columns that one lacks are null there."""
    return dealt_union(["series_id"], *frames)


def residual_load(load: DataFrame, pv: DataFrame, onshore: DataFrame, offshore: DataFrame, min_hours: int = 0) -> DataFrame:
    """load minus generation at the hours all four have; series with fewer common hours go."""
    parts = [x.select("series_id", "ts", F.col("value").alias(n)) for x, n in ((load, "l"), (pv, "pv"), (onshore, "on"), (offshore, "off"))]
    x = parts[0]
    for p in parts[1:]:
        x = x.join(p, ["series_id", "ts"])
    x = x.na.drop(subset=["l", "pv", "on", "off"]).withColumn("value", F.expr("l - (pv + on + off)"))
    n = F.count("*").over(W.partitionBy("series_id"))
    return x.withColumn("n", n).where(F.col("n") >= min_hours).select("series_id", "ts", "value")


def generation_frame(parts: DataFrame, names: Sequence[str]) -> DataFrame:
    """(ts, part, value) -> hourly means of each part as columns, and their sum; incomplete hours go."""
    means = [F.avg(F.when(F.col("part") == n, finite("value"))).alias(n) for n in names]
    out = parts.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(*means).na.drop()
    return out.withColumn("total", sum((F.col(n) for n in names), F.lit(0.0)))


def scalar_to_horizon(df: DataFrame, value: Column, hours: int = 24, name: str = "value") -> DataFrame:
    """One row per hour of the horizon with the same value."""
    return df.select("*", F.posexplode(F.array_repeat(value, hours)).alias("hour", name))


def available(hour: Column, start: Column, end: Column) -> Column:
    """hour in [start, end), over midnight where end < start; equal ends mean always."""
    return F.when(start == end, True).when(start < end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))


def weather_on_days(days: DataFrame, weather: DataFrame, columns: Sequence[str], zone: str = "UTC") -> DataFrame:
    """Weather columns at each (local_date, hour) of a day matrix."""
    local = local_time("ts", zone)
    w = weather.groupBy(F.to_date(local).alias("local_date"), F.hour(local).alias("hour")).agg(*(F.avg(finite(c)).alias(c) for c in columns))
    return days.join(w, ["local_date", "hour"], "left")


def days_with_weather(days: DataFrame, weather: DataFrame, zone: str = "UTC") -> DataFrame:
    """Days whose weather has all 24 local hours, each with some value; the day index closes up."""
    local = local_time("ts", zone)
    known = [F.col(c).isNotNull() for c in weather.columns if c != "ts"]
    full = (weather.where(reduce(or_, known)) if known else weather).groupBy(F.to_date(local).alias("local_date")).agg(F.count_distinct(F.hour(local)).alias("n")).where("n = 24").select("local_date")
    kept = days.join(full, "local_date", "left_semi").drop("day_idx")
    return kept.withColumn("day_idx", F.dense_rank().over(W.partitionBy("series_id").orderBy("local_date")) - 1)


def weighted_locations(weather: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(location, ts, weight, columns) -> weighted mean over locations per ts."""
    return weather.groupBy("ts").agg(*(F.try_divide(F.sum(F.col(c) * F.col("weight")), F.sum(F.when(F.col(c).isNotNull(), F.col("weight")))).alias(c) for c in columns))
