"""Decisions under residual scenarios: nomination, overload, hosting capacity, fleets, hot spots.

Scenario sets are arrays of residuals per (asset, hour): bounded by the residual window, so folds
over them stay inside a row and many assets run in parallel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import array_quantile, clip
from .relations import dealt_union


def nomination(point: Column, residuals: Column, c_short: float, c_long: float) -> Column:
    """Newsvendor: the point plus the residual quantile at c_short / (c_short + c_long)."""
    return point + array_quantile(F.array_sort(residuals), c_short / (c_short + c_long))


def imbalance_cost(actual: Column, nominated: Column, c_short: float, c_long: float) -> Column:
    d = actual - nominated
    return F.when(d > 0, c_short * d).otherwise(-c_long * d)


def expected_cost(point: Column, residuals: Column, nominated: Column, c_short: float, c_long: float) -> Column:
    total = F.aggregate(residuals, F.lit(0.0), lambda a, r: a + imbalance_cost(point + r, nominated, c_short, c_long))
    return F.try_divide(total, F.size(residuals))


def let(value: Column, f) -> Column:
    """f(value) with value computed once, also inside a fold."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _cvar(costs: Column, alpha: float) -> Column:
    """Of sorted costs."""

    def tail(var: Column) -> Column:
        return var + F.aggregate(costs, F.lit(0.0), lambda a, c: a + F.greatest(c - var, F.lit(0.0))) / ((1 - alpha) * F.size(costs))

    return let(array_quantile(costs, alpha), tail)


def cvar_nomination(rows: DataFrame, c_short: float, c_long: float, beta: float = 0.5, alpha: float = 0.9, steps: int = 64) -> DataFrame:
    """(point_kw, residuals) -> the nomination with the least (1 - beta) E + beta CVaR over an even grid of
    `steps` + 1 amounts between the least and the greatest scenario; the objective is convex."""
    actual = F.transform("residuals", lambda r: F.col("point_kw") + r)
    x = rows.withColumn("lo", F.array_min(actual)).withColumn("hi", F.array_max(actual)).withColumn("actual", actual)
    amounts = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / steps)

    def scored(q: Column) -> Column:
        def objective(costs: Column) -> Column:
            mean = F.aggregate(costs, F.lit(0.0), lambda s, c: s + c) / F.size(costs)
            value = (1 - beta) * mean + beta * _cvar(costs, alpha)
            # amounts whose objectives differ by rounding only are equal: the smaller one counts
            return F.struct(F.round(value, 9).alias("level"), q.alias("nomination_kw"), value.alias("objective"))

        return let(F.array_sort(F.transform("actual", lambda a: imbalance_cost(a, q, c_short, c_long))), objective)

    best = F.array_min(F.transform(amounts, scored))
    return x.withColumn("best", best).select(*rows.columns, "best.nomination_kw", "best.objective")


def overload(rows: DataFrame, risk_alpha: float = 0.05, dt_h: float = 1.0) -> DataFrame:
    """(asset_id, hour, point_kw, residuals, rating_kw): probability that point + residual exceeds the rating
    (strictly), expected excess energy, median and p90 load, at_risk."""
    load = F.transform("residuals", lambda r: F.col("point_kw") + r)
    over = F.filter("load", lambda v: v > F.col("rating_kw"))
    excess = F.aggregate("load", F.lit(0.0), lambda a, v: a + F.greatest(v - F.col("rating_kw"), F.lit(0.0)))
    x = rows.withColumn("load", F.array_sort(load))
    x = x.withColumns(
        {
            "p_overload": F.try_divide(F.size(over).cast("double"), F.size("load")),
            "expected_excess_kwh": F.try_divide(excess, F.size("load")) * dt_h,
            "p50_kw": array_quantile("load", 0.5),
            "p90_kw": array_quantile("load", 0.9),
        }
    )
    return x.withColumn("at_risk", F.col("p_overload") > risk_alpha).drop("load")


def overload_day(hours: DataFrame) -> DataFrame:
    """Over the hours of an asset: 1 - prod(1 - p), total expected excess, hours at risk."""
    alive = F.aggregate(F.collect_list("p_overload"), F.lit(1.0), lambda a, p: a * (1 - p))
    return hours.groupBy("asset_id").agg(
        (1 - alive).alias("p_any"), F.sum("expected_excess_kwh").alias("excess_kwh"),
        F.sum(F.col("at_risk").cast("long")).alias("hours_at_risk")
    )


def hosting_capacity(rows: DataFrame, risk_alpha: float = 0.05) -> DataFrame:
    """Largest constant extra load per asset that keeps every hour's overload probability within
    risk_alpha: rating - point - the (floor(alpha n) + 1)-th largest residual, least over hours."""
    s = F.sort_array("residuals", asc=False)
    m = F.floor(risk_alpha * F.size("residuals") + 1e-12).cast("int") + 1
    room = F.col("rating_kw") - F.col("point_kw") - F.element_at(s, m)
    return rows.groupBy("asset_id").agg(F.greatest(F.lit(0.0), F.least(F.min(room), F.first("rating_kw"))).alias("hosting_kw"))


def fleet_scenario(rows: DataFrame, fleets: DataFrame, factor: float = 1.0) -> DataFrame:
    """Adds fleets (fleet, sign, units, rated_kw, coincidence, profile array by hour) to every asset's points;
    the coincidence factor is scaled and clamped to [0, 1]."""
    k = clip(F.col("coincidence") * factor, 0.0, 1.0)
    x = fleets.select(F.posexplode("profile").alias("hour", "share"), (F.col("sign") * F.col("units") * F.col("rated_kw") * k).alias("peak"))
    added = x.groupBy("hour").agg(F.sum(F.col("peak") * F.col("share")).alias("added_kw"))
    return rows.join(added, "hour", "left").withColumn("added_kw", F.coalesce("added_kw", F.lit(0.0))).withColumn("point_kw", F.col("point_kw") + F.col("added_kw"))


def coincidence_band(rows: DataFrame, fleets: DataFrame, factors=(0.5, 1.0, 1.5), risk_alpha: float = 0.05) -> DataFrame:
    """Overload of the day before and with the fleets at several coincidence factors."""
    out = [overload_day(overload(rows, risk_alpha)).withColumn("factor", F.lit(0.0))]
    for f in factors:
        out.append(overload_day(overload(fleet_scenario(rows, fleets, f), risk_alpha)).withColumn("factor", F.lit(float(f))))
    return dealt_union(["factor"], *out)


# Documented defaults of an oil-immersed distribution transformer.
THERMAL = {"oil_rise": 55.0, "winding_rise": 23.0, "loss_ratio": 5.0, "oil_exponent": 0.8, "winding_exponent": 1.6, "tau_oil_h": 3.0, "tau_winding_h": 0.25}


def hot_spots(load_pu: Column, ambient: Column, dt_h: float = 1.0, p: dict = THERMAL) -> Column:
    """Array of hot-spot temperatures for arrays of per-unit load and ambient temperature: a first-order
    lag of oil and winding rise from the steady state of the first period."""
    oil = lambda k: p["oil_rise"] * F.pow((k * k * p["loss_ratio"] + 1) / (p["loss_ratio"] + 1), p["oil_exponent"])
    winding = lambda k: p["winding_rise"] * F.pow(k, p["winding_exponent"])
    go, gw = 1 - math.exp(-dt_h / p["tau_oil_h"]), 1 - math.exp(-dt_h / p["tau_winding_h"])
    loads = F.transform(load_pu, lambda k: F.greatest(F.lit(0.0), k))
    first = F.element_at(loads, 1)
    zero = F.struct(oil(first).alias("o"), winding(first).alias("w"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        o, w = acc["o"] + (oil(x["k"]) - acc["o"]) * go, acc["w"] + (winding(x["k"]) - acc["w"]) * gw
        return F.struct(o.alias("o"), w.alias("w"), F.concat(acc["out"], F.array(x["a"] + o + w)).alias("out"))

    return F.aggregate(F.zip_with(loads, ambient, lambda k, a: F.struct(k.alias("k"), a.alias("a"))), zero, step, lambda acc: acc["out"])


def ageing(temperature: Column) -> Column:
    return F.pow(F.lit(2.0), (temperature - 98.0) / 6.0)


def thermal_path(assets: DataFrame, dt_h: float = 1.0) -> DataFrame:
    """(asset_id, load_kw array, ambient_c array, rating_kw) -> hot-spot array, peak and loss of life in hours."""
    pu = F.transform("load_kw", lambda v: v / F.col("rating_kw"))
    x = assets.withColumn("hotspot_c", hot_spots(pu, F.col("ambient_c"), dt_h))
    loss = F.aggregate("hotspot_c", F.lit(0.0), lambda a, t: a + ageing(t) * dt_h)
    return x.withColumn("peak_c", F.array_max("hotspot_c")).withColumn("loss_h", loss)


def thermal_risk(rows: DataFrame, limit_c: float = 120.0, risk_alpha: float = 0.05, dt_h: float = 1.0) -> DataFrame:
    """(asset_id, hour, point_kw, residuals, rating_kw, ambient_c): scenario i takes the i-th residual of every
    hour; peaks and losses over the paths."""
    path = rows.select("asset_id", "hour", "rating_kw", "ambient_c", "point_kw", F.posexplode("residuals").alias("scenario", "r"))
    arrays = path.groupBy("asset_id", "scenario").agg(
        F.array_sort(F.collect_list(F.struct("hour", (F.col("point_kw") + F.col("r")).alias("kw"), "ambient_c"))).alias("h"), F.first("rating_kw").alias("rating_kw")
    )
    arrays = arrays.select("asset_id", "scenario", "rating_kw", F.col("h.kw").alias("load_kw"), F.col("h.ambient_c").alias("ambient_c"))
    x = thermal_path(arrays, dt_h)
    return x.groupBy("asset_id").agg(
        F.count("*").alias("scenarios"),
        F.avg((F.col("peak_c") > limit_c).cast("double")).alias("p_exceed"),
        F.percentile("peak_c", 0.5).alias("peak_p50"),
        F.percentile("peak_c", 0.9).alias("peak_p90"),
        F.avg("loss_h").alias("loss_h"),
    ).withColumn("at_risk", F.col("p_exceed") > risk_alpha)
