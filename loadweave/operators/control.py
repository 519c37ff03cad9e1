"""Allocation under limits: water-filling, pools, redispatch, tariffs, schedules.

The bisections of the textbook forms have closed forms on sorted prefix sums, so each is a window
over the devices of one group (hour, pool, feeder). Groups are independent and spread by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clip
from .metrics import cumulative
from .relations import dealt_union

FLOOR_KW = 4.2


def normalise_devices(devices: DataFrame, floor: float = FLOOR_KW, by: Sequence[str] = ()) -> DataFrame:
    """Defaults for floor_kw and weight, device_index by id; rows with a negative demand or floor or a
    weight that isn't positive are marked invalid."""
    x = devices.withColumn("floor_kw", F.coalesce("floor_kw", F.lit(floor))).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    x = x.withColumn("valid", (F.col("demand_kw") >= 0) & (F.col("floor_kw") >= 0) & (F.col("weight") > 0))
    return x.withColumn("device_index", F.row_number().over(W.partitionBy(*by).orderBy("device_id")) - 1)


def water_fill(devices: DataFrame, by: Sequence[str], floor: float = FLOOR_KW, cap: str = "cap_kw", digits: int | None = 3) -> DataFrame:
    """Common level for (by, device_id, demand_kw, cap_kw): limit = min(demand, max(level, floor)) with the
    limits summing to the cap. No congestion: the demand. Cap below n * floor: the floor for all,
    even above a demand. Adds level, limit_kw (rounded to `digits`), shed_kw, feasible."""
    group = W.partitionBy(*by)
    order = group.orderBy("demand_kw", "device_id")
    d = F.col("demand_kw")
    x = devices.withColumns({"n": F.count("*").over(group), "total": F.sum(d).over(group), "k": F.row_number().over(order)})
    prefix = F.coalesce(F.sum(d).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("candidate", (F.col(cap) - prefix) / (F.col("n") - F.col("k") + 1))
    level = F.min_by("candidate", F.when(F.col("candidate") <= d + 1e-12, F.col("k"))).over(group)
    x = x.withColumn("level", level).withColumn("feasible", F.col(cap) >= F.col("n") * floor)
    # demands below the floor keep theirs; others share what is left, at least the floor each
    limit = F.when(F.col("total") <= F.col(cap), d).when(~F.col("feasible"), F.lit(floor)).otherwise(F.least(d, F.greatest(F.col("level"), F.lit(floor))))
    return x.withColumn("limit_kw", limit if digits is None else F.round(limit, digits)).withColumn("shed_kw", d - F.col("limit_kw")).drop("n", "total", "k", "candidate")


def weighted_fill(devices: DataFrame, by: Sequence[str], cap: str = "cap_kw", digits: int | None = 3) -> DataFrame:
    """Pressure x with limit = clip(demand - weight * x, floor, demand) and limits summing to the cap, for
    (by, device_id, demand_kw, floor_kw, weight, cap_kw). Floors are at most the demand. Cap below
    the floors: all at their floor."""
    group = W.partitionBy(*by)
    d, w = F.col("demand_kw"), F.col("weight")
    x = devices.withColumn("f", F.least("floor_kw", "demand_kw"))
    f = F.col("f")
    x = x.withColumns({"b": (d - f) / w, "total": F.sum(d).over(group), "floors": F.sum(f).over(group)})
    order = group.orderBy("b", "device_id")
    done = order.rowsBetween(W.unboundedPreceding, -1)
    # the rows from this one on, summed from the far end: a frame that ends at the last row is summed anew for each row
    ahead = group.orderBy(F.col("b").desc(), F.col("device_id").desc()).rowsBetween(W.unboundedPreceding, 0)
    nominal = F.sum(d).over(ahead) + F.coalesce(F.sum(f).over(done), F.lit(0.0))
    x = x.withColumn("candidate", (nominal - F.col(cap)) / F.sum(w).over(ahead)).withColumn("k", F.row_number().over(order))
    pressure = F.min_by("candidate", F.when(F.col("candidate") <= F.col("b") + 1e-12, F.col("k"))).over(group)
    x = x.withColumn("pressure", pressure).withColumn("feasible", F.col(cap) >= F.col("floors"))
    limit = F.when(F.col("total") <= F.col(cap), d).when(~F.col("feasible"), f).otherwise(clip(d - w * F.col("pressure"), f, d))
    return x.withColumn("limit_kw", limit if digits is None else F.round(limit, digits)).withColumn("shed_kw", d - F.col("limit_kw")).drop("f", "b", "total", "floors", "candidate", "k")


def pool_dispatch(assets: DataFrame, periods: DataFrame, dt_h: float = 1.0, digits: int | None = 3) -> DataFrame:
    """Weighted fill of (pool_id, device_id, ...) in each (pool_id, hour, cap_kw): energy and shed energy
    per asset and whether every period is safe."""
    x = weighted_fill(periods.join(assets, "pool_id"), ["pool_id", "hour"], digits=digits)
    return x.groupBy("pool_id", "device_id").agg(
        (F.sum("limit_kw") * dt_h).alias("energy_kwh"), (F.sum("shed_kw") * dt_h).alias("shed_kwh"), F.bool_and("feasible").alias("safe")
    )


def pool_band(assets: DataFrame) -> DataFrame:
    return assets.groupBy("pool_id").agg(F.sum(F.least("floor_kw", "demand_kw")).alias("least_kw"), F.sum("demand_kw").alias("most_kw"))


def _at_or_after(asked: DataFrame, index: DataFrame, keys: Sequence[str], place: str, found: Sequence[str]) -> DataFrame:
    """Each row of asked(keys, place, ...) with the columns `found` of the first row of index(keys, block, place, found) at or after
    its place, null where there is none. Blocks are looked up first, by their last places, then the row in its block: no
    task sorts a key's index as a whole, and rows grow with asked and index together."""

    def lookup(a: DataFrame, b: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
        row, hit = F.struct(*a.columns), F.struct(*columns)
        left = a.select(*by, place, row.alias("row"), F.lit(None).cast(b.select(hit.alias("h")).schema["h"].dataType).alias("hit"), F.lit(1).alias("side"))
        right = b.select(*by, place, F.lit(None).cast(left.schema["row"].dataType).alias("row"), hit.alias("hit"), F.lit(0).alias("side"))
        down = W.partitionBy(*by).orderBy(F.col(place).desc(), "side").rowsBetween(W.unboundedPreceding, 0)
        near = dealt_union(by, left, right).withColumn("hit", F.last("hit", ignorenulls=True).over(down)).where("side = 1")
        return near.select("row.*", "hit.*")

    blocks = index.groupBy(*keys, "block").agg(F.max(place).alias(place))
    return lookup(lookup(asked, blocks, keys, ["block"]), index, [*keys, "block"], found).drop("block")


def redispatch(hours: DataFrame, devices: DataFrame, threshold: float, floor: float = FLOOR_KW, digits: int | None = 3, block: int = 4096) -> DataFrame:
    """(feeder_id, hour, forecast_kw) x (feeder_id, device_id, demand_kw): in hours above the threshold the
    devices share threshold - (forecast - their demand), water_fill()'s common level; then shed and safety, against naive
    dimming to the floor. One row an hour.

    The sum of the limits depends on the hour only by its level. So a feeder's demands are counted and summed up once, by value,
    and each hour's level is looked up in these sums: rows grow with devices + hours, not with their product."""
    r = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    d, zero = F.col("demand_kw"), F.lit(0.0)
    counted = devices.groupBy("feeder_id", "demand_kw").agg(F.count("*").alias("c"))
    counted = counted.withColumns({"s": F.col("c") * d, "r": F.col("c") * r(d)})
    index = cumulative(counted, ["feeder_id"], "demand_kw", ["c", "s", "r"])
    rest = F.col("all_c") - F.col("upto_c") + F.col("c")  # devices from this demand on
    index = index.select(
        "feeder_id", F.floor((F.col("upto_c") - F.col("c")) / block).alias("block"), ((F.col("upto_s") - F.col("s")) + rest * d + 1e-12).alias("sum"),
        (F.col("upto_s") - F.col("s")).alias("below"), (F.col("upto_r") - F.col("r")).alias("below_limits"), rest.alias("rest"),
    )  # sum: of the limits, if this demand is the level
    low = F.least(d, F.lit(floor))
    demand = counted.groupBy("feeder_id").agg(
        F.sum("s").alias("demand"), F.sum("c").alias("n"), F.sum(F.col("c") * F.greatest(d - floor, zero)).alias("naive"), F.sum(F.col("c") * r(low)).alias("floored")
    )
    x = hours.join(demand, "feeder_id").withColumn("congested", F.col("forecast_kw") > threshold)
    x = x.withColumn("sum", F.greatest(zero, threshold - (F.col("forecast_kw") - F.col("demand"))))
    x = _at_or_after(x, index, ["feeder_id"], "sum", ["below", "below_limits", "rest"])
    cap, level = F.col("sum"), (F.col("sum") - F.col("below")) / F.col("rest")
    feasible = cap >= F.col("n") * floor
    limits = F.when(~feasible, F.col("n") * r(F.lit(floor))).when(level < floor, F.col("floored")).otherwise(F.col("below_limits") + F.col("rest") * r(level))
    shed = F.when(F.col("congested"), F.col("demand") - limits).otherwise(zero)
    return x.select(
        "feeder_id",
        "hour",
        "forecast_kw",
        "congested",
        shed.alias("shed_kw"),
        F.when(F.col("congested"), F.col("naive")).otherwise(zero).alias("naive_shed_kw"),
        (F.col("forecast_kw") - shed).alias("managed_kw"),
        (~F.col("congested") | feasible).alias("feasible"),
    )


def energy_saved(plan: DataFrame) -> DataFrame:
    """Shed energy against naive dimming, percent saved per feeder."""
    x = plan.groupBy("feeder_id").agg(F.sum("shed_kw").alias("shed"), F.sum("naive_shed_kw").alias("naive"), F.sum(F.col("congested").cast("long")).alias("hours"))
    return x.withColumn("saved_percent", 100 * (1 - F.try_divide("shed", "naive")))


def congestion_window(hours: DataFrame, threshold: float) -> DataFrame:
    """First and last hour whose p90 exceeds the threshold, gaps included, and one cap from the worst."""
    x = hours.where(F.col("p90") > threshold).groupBy("feeder_id")
    return x.agg(
        F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count("*").alias("n_hours"),
        F.greatest(F.lit(0.0), 2 * threshold - F.max("p90")).alias("cap")
    )


def tariff_placement(hours: DataFrame, by: Sequence[str], energy: str = "energy_kwh", dt_h: float = 1.0) -> DataFrame:
    """(by, hour, fee, p_max_kw, cap_kw, available, energy_kwh): the cheapest hours first, the earlier on equal
    fees, each up to its ceiling; and naive filling by time. Adds kwh, naive_kwh."""
    ceiling = F.when(F.coalesce("available", F.lit(True)), F.greatest(F.lit(0.0), F.least("p_max_kw", "cap_kw")) * dt_h).otherwise(0.0)
    x = hours.withColumn("ceiling", ceiling)
    for name, order in (("kwh", ["fee", "hour"]), ("naive_kwh", ["hour"])):
        placed = F.coalesce(F.sum("ceiling").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        x = x.withColumn(name, F.greatest(F.lit(0.0), F.least(F.col("ceiling"), F.col(energy) - placed)))
    return x.drop("ceiling")


def tariff_summary(placed: DataFrame, by: Sequence[str], energy: str = "energy_kwh") -> DataFrame:
    out = placed.groupBy(*by).agg(
        F.sum("kwh").alias("placed_kwh"), F.sum(F.col("kwh") * F.col("fee")).alias("cost"), F.sum(F.col("naive_kwh") * F.col("fee")).alias("naive_cost"), F.max(energy).alias("wanted")
    )
    return out.withColumn("shortfall_kwh", F.col("wanted") - F.col("placed_kwh")).withColumn("saving", F.col("naive_cost") - F.col("cost")).drop("wanted")


def plan_day(hours: DataFrame, threshold: float, c_short: float, c_long: float) -> DataFrame:
    """(plan_id, hour, base_kw, residuals array, fee, p_max_kw, energy_kwh) -> placement under the caps that the
    base leaves below the threshold, the cost-optimal nomination and grid safety, by hour."""
    from .risk import nomination

    x = hours.withColumn("cap_kw", F.greatest(F.lit(0.0), threshold - F.col("base_kw"))).withColumn("available", F.lit(True))
    x = tariff_placement(x, ["plan_id"]).withColumn("total_kw", F.col("base_kw") + F.col("kwh"))
    x = x.withColumn("nomination_kw", nomination(F.col("total_kw"), F.col("residuals"), c_short, c_long))
    return x.withColumn("grid_safe", F.col("total_kw") <= threshold + 1e-9)


# --- schedules ----------------------------------------------------------------------------------
def validate_schedule(points: DataFrame, default_floor: float = FLOOR_KW) -> DataFrame:
    """(malo, start_ts, end_ts, p_limit_kw, floor_kw?) with an array of what is wrong."""
    floor = F.coalesce("floor_kw", F.lit(default_floor))
    tests = {"short_id": F.length("malo") < 6, "below_floor": F.col("p_limit_kw") < floor, "no_duration": F.col("end_ts") <= F.col("start_ts")}
    return points.withColumn("errors", F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests.items()))))


def _grains(ts: str, grain_s: int) -> Column:
    return F.unix_micros(ts) / F.lit(grain_s * 1e6)


def _spans(points: DataFrame, key: str, grain_s: int) -> DataFrame:
    """Intervals of some duration from grain a to before grain b, with the length of their blocks."""
    spans = points.where("end_ts > start_ts").select(
        key, "start_ts", "end_ts", "p_limit_kw", F.floor(_grains("start_ts", grain_s)).alias("a"), F.ceil(_grains("end_ts", grain_s)).alias("b")
    )
    return spans.withColumn("length", F.greatest(F.lit(0), F.floor(F.log2(F.col("b") - F.col("a"))).cast("int")))


def _blocks(spans: DataFrame, key: str) -> DataFrame:
    """_spans() as a row for each block that they lie in."""
    size = F.pow(F.lit(2.0), F.col("length"))
    block = F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size))).alias("block")
    spans = spans.select(key, "length", block, "start_ts", "end_ts", "p_limit_kw")
    return spans.select(key, (F.col("block") * 64 + F.col("length")).alias("at"), "start_ts", "end_ts", "p_limit_kw")


def active_limit(readings: DataFrame, points: DataFrame, key: str = "malo", grain_s: int = 3600) -> DataFrame:
    """Each reading with the lowest limit whose [start, end) holds its ts; repeated readings stay.

    An interval is covered by at most three dyadic blocks of one length, the largest power of two of grains within its duration. A
    reading meets the block of each length in use that holds it, so the range join is an equi-join by key and numbered block (block * 64
    + length): an interval's rows don't grow with its duration, a reading's with its logarithm at most; the exact times then
    decide. Shorter blocks would bring fewer pairs that miss, but what is shuffled is the blocks."""
    spans = _spans(points, key, grain_s)
    used = sorted(r["length"] for r in spans.select("length").distinct().collect())  # some twenty lengths, however many intervals
    if not used:
        return readings.withColumn("active_limit_kw", F.lit(None).cast("double"))
    spans = _blocks(spans, key)
    own = F.array(*(F.floor(_grains("ts", grain_s) / 2**k) * 64 + k for k in used))
    r = readings.select(key, "ts", F.explode(own).alias("at"))
    met = r.join(spans, [key, "at"]).where("ts >= start_ts and ts < end_ts")
    # a limit belongs to a key and a time, however many readings there are of them
    return readings.join(met.groupBy(key, "ts").agg(F.min("p_limit_kw").alias("active_limit_kw")), [key, "ts"], "left").select(*readings.columns, "active_limit_kw")


def to_lpc(points: DataFrame, floor: float = FLOOR_KW) -> DataFrame:
    """Setpoints as watts with a duration; the failsafe is the lowest floor of the schedule."""
    duration = F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts")
    safe = F.min(F.coalesce("floor_kw", F.lit(floor))).over(W.partitionBy("malo"))
    return points.select("malo", "start_ts", (F.col("p_limit_kw") * 1000).alias("limit_w"), duration.alias("duration_s"), (safe * 1000).alias("failsafe_w"))


def receive(commands: DataFrame, least: float = FLOOR_KW) -> DataFrame:
    """A receiver's answer: limits below `least` are refused, else min(desired, limit) applies."""
    ok = F.col("p_limit_kw") >= least
    return commands.withColumn("accepted", ok).withColumn("applied_kw", F.when(ok, F.least("desired_kw", "p_limit_kw")))
