"""Baselines and features on the day matrix (series_id, day_idx, local_date, hour, value).

Lags are over retained days; every frame ends before the day it describes, so nothing leaks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIRST = 8
FIRST_SMALL = 14


def by_hour():
    """Days of the same series and hour, in order."""
    return W.partitionBy("series_id", "hour").orderBy("day_idx")


def baselines(days: DataFrame) -> DataFrame:
    """Adds persist (the day before) and snaive (seven days before), and the residual target."""
    x = days.withColumn("persist", F.lag("value", 1).over(by_hour())).withColumn("snaive", F.lag("value", 7).over(by_hour()))
    return x.withColumn("target", F.col("value") - F.col("snaive"))


def holiday_aware_base(days: DataFrame, holidays: DataFrame | None, weeks: int = 8) -> DataFrame:
    """Adds base: the value 7, 14, ... days back, passing over holidays while an earlier step exists; the
    oldest step counts even if it is a holiday. `weeks` bounds the walk. Without holidays it is the
    value 7 days back."""
    if holidays is None:
        return days.withColumn("base", F.lag("value", 7).over(by_hour()))
    h = holidays.select(F.col("holiday").alias("local_date"), F.lit(True).alias("hol")).distinct()
    x = days.join(h, "local_date", "left").withColumn("hol", F.coalesce("hol", F.lit(False)))
    steps = [F.struct(F.lag("value", 7 * k).over(by_hour()).alias("v"), F.lag("hol", 7 * k).over(by_hour()).alias("h")) for k in range(1, weeks + 1)]
    x = x.withColumn("back", F.filter(F.array(*steps), lambda s: s["h"].isNotNull()))
    free = F.filter("back", lambda s: ~s["h"])
    base = F.coalesce(F.try_element_at(free, F.lit(1))["v"], F.try_element_at("back", F.lit(-1))["v"])
    return x.select(*days.columns, base.alias("base"))


def _harmonics(angle: Column, name: str, orders: tuple[int, ...]) -> dict[str, Column]:
    return {f"{f}_{name}{k}": g(angle * k) for k in orders for f, g in (("sin", F.sin), ("cos", F.cos))}


def slots(days: DataFrame) -> Column:
    """Steps of a day: the column slots, where series differ in it, else 24."""
    return F.col("slots") if "slots" in days.columns else F.lit(24)


def calendar(days: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Adds hour and weekday harmonics, weekend and holiday. With a column slots, hour numbers the steps of the day."""
    hour, dow = F.col("hour") * (2 * math.pi / slots(days)), F.weekday("local_date") * (2 * math.pi / 7)
    x = days.withColumns(_harmonics(hour, "h", (1, 2)) | _harmonics(dow, "d", (1,)))
    x = x.withColumn("weekend", (F.weekday("local_date") >= 5).cast("double"))
    if holidays is None:
        return x.withColumn("holiday", F.lit(0.0))
    h = holidays.select(F.col("holiday").alias("local_date"), F.lit(1.0).alias("holiday")).distinct()
    return x.join(h, "local_date", "left").withColumn("holiday", F.coalesce("holiday", F.lit(0.0)))


# The feature columns in order.
FEATURES = ["one", "dev_prev", "dev_mean", "trend", "week_step", "sin_h1", "cos_h1", "sin_h2", "cos_h2", "sin_d1", "cos_d1", "weekend", "holiday"]
SMALL = ["d_2_9", "d_3_10", "d_7_14", "roll3", "roll7", "evening_dev", "morning_dev", "weekend_evening", "weekend_morning"]
EXTENDED = ["lag2", "roll3", "weekend_evening"]


def features(days: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """The 13 features of FEATURES, the baselines persist and snaive, the holiday-aware base and the target (value
    minus base); rows from day 8 on. Other columns of days, such as weather, stay.

    dev_prev: yesterday against the same day a week earlier, at this hour; dev_mean and trend: the same
    of day means (as the mean deviation and as the deviation of means); week_step: yesterday against
    the value a week ago."""
    lag = lambda k: F.lag("value", k).over(by_hour())
    x = days.withColumn("day_mean", F.avg("value").over(W.partitionBy("series_id", "day_idx")))
    mean = lambda k: F.lag("day_mean", k).over(by_hour())
    x = x.withColumns(
        {
            "one": F.lit(1.0),
            "snaive": lag(7),
            "persist": lag(1),
            "dev_prev": lag(1) - lag(8),
            "dev_mean": mean(1) - mean(8),
            "trend": mean(1) - mean(8),
            "week_step": lag(1) - lag(7),
        }
    )
    x = calendar(holiday_aware_base(x, holidays), holidays).withColumn("target", F.col("value") - F.col("base"))
    return x.where(F.col("day_idx") >= FIRST)


def _bump(days: DataFrame, at: float) -> Column:
    """A bell of two hours' width."""
    return F.exp(-F.pow(F.col("hour") * (24 / slots(days)) - at, 2) / 8)


def small_load_features(days: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """The 13 features and the 9 of SMALL for small, nervous loads; rows from day 14 on. The deviations of
    evening and morning are those of the day means."""
    lag = lambda k: F.lag("value", k).over(by_hour())
    roll = lambda k: F.avg("value").over(by_hour().rowsBetween(-k, -1)) - lag(7)
    x = days.withColumns({"d_2_9": lag(2) - lag(9), "d_3_10": lag(3) - lag(10), "d_7_14": lag(7) - lag(14), "roll3": roll(3), "roll7": roll(7)})
    bells = {"evening": _bump(days, 19.0), "morning": _bump(days, 8.0)}
    x = features(x, holidays)
    x = x.withColumns({f"{k}_dev": F.col("trend") * v for k, v in bells.items()} | {f"weekend_{k}": F.col("weekend") * v for k, v in bells.items()})
    return x.where(F.col("day_idx") >= FIRST_SMALL)


def extended_features(days: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """The 13 features and the three of EXTENDED (the deviation two days back, that of the last three days' mean,
    weekend evenings); rows from day 9 on."""
    lag = lambda k: F.lag("value", k).over(by_hour())
    x = days.withColumns({"lag2": lag(2) - lag(9), "roll3": F.avg("value").over(by_hour().rowsBetween(-3, -1)) - lag(7)})
    x = features(x, holidays).withColumn("weekend_evening", F.col("weekend") * _bump(days, 19.0))
    return x.where(F.col("day_idx") >= FIRST + 1)


def generation_features(days: DataFrame, proxy: str) -> DataFrame:
    """Proxy, its square and hour, weekday and day-of-year harmonics for generation bias models."""
    year = F.dayofyear("local_date") * (2 * math.pi / 365.25)
    x = days.withColumn("one", F.lit(1.0)).withColumn("proxy", F.col(proxy)).withColumn("proxy2", F.col(proxy) * F.col(proxy))
    hour, dow = F.col("hour") * (2 * math.pi / 24), F.weekday("local_date") * (2 * math.pi / 7)
    return x.withColumns(_harmonics(hour, "h", (1, 2)) | _harmonics(dow, "d", (1,)) | _harmonics(year, "y", (1, 2)))
