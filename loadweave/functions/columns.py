"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column | str, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, col(x)))


def finite(x: Column | str) -> Column:
    """NaN and infinities as null: the only missing value inside the engine."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


# Factors to MW (power) and MWh (energy).
POWER_TO_MW = {"W": 1e-6, "KW": 1e-3, "MW": 1.0, "GW": 1e3}
ENERGY_TO_MWH = {"WH": 1e-6, "KWH": 1e-3, "MWH": 1.0, "GWH": 1e3}


def unit_factor(unit: Column | str, table: dict[str, float] = POWER_TO_MW) -> Column:
    """Factor of a unit name, case and blanks ignored; null for an unknown unit."""
    key = F.upper(F.trim(col(unit)))
    out = F.lit(None).cast("double")
    for name, factor in table.items():
        out = F.when(key == name, F.lit(factor)).otherwise(out)
    return out


def local_time(ts: Column | str, zone: str = "Europe/Berlin") -> Column:
    return F.from_utc_timestamp(col(ts), zone)


def localize(local: Column | str, second: Column | None = None, zone: str = "Europe/Berlin") -> Column:
    """Local wall-clock time to UTC. A time inside the spring gap moves to the gap's end. A time that
    occurs twice in autumn is standard time, unless `second` says false (then summer time)."""
    local = col(local)
    utc = F.to_utc_timestamp(local, zone)
    shown = F.from_utc_timestamp(utc, zone)
    # in the gap the round trip shows a later wall clock: the gap ends at the next full hour of the clock
    gap = shown != local
    in_gap = F.to_utc_timestamp(F.date_trunc("hour", local) + F.expr("INTERVAL 1 HOUR"), zone)
    later = utc + F.expr("INTERVAL 1 HOUR")
    twice = F.from_utc_timestamp(later, zone) == local
    late = F.lit(True) if second is None else F.coalesce(second, F.lit(True))
    return F.when(gap, in_gap).when(twice & late, later).otherwise(utc)


def german_number(x: Column | str, comma: Column, dotted: Column) -> Column:
    """A number as text; comma and dotted say what the column uses (see parse_numbers)."""
    x = F.trim(col(x))
    plain = F.when(comma, F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".")).when(dotted, F.regexp_replace(x, r"\.", "")).otherwise(x)
    return plain.try_cast("double")


def parse_numbers(df: DataFrame, source: str, target: str) -> DataFrame:
    """Decide once for the column: over 20 % with a comma means German decimals, else over 20 % like
    1.234 or 1.234.567 means dots group thousands. Unreadable values become null."""
    return parse_columns(df, {source: target})


def parse_columns(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    """parse_numbers() of each source; one aggregation decides for all of them."""
    shares = []
    for k, source in enumerate(targets):
        seen = F.col(source).isNotNull()
        shares.append(F.avg(F.when(seen, F.col(source).contains(",").cast("double"))).alias(f"c{k}"))
        shares.append(F.avg(F.when(seen, F.trim(source).rlike(r"^-?\d{1,3}(\.\d{3})+$").cast("double"))).alias(f"d{k}"))
    share = df.agg(*shares).first()
    much = [[F.lit((share[f"{c}{k}"] or 0) > 0.2) for c in "cd"] for k in range(len(targets))]
    return df.withColumns({target: german_number(source, *much[k]) for k, (source, target) in enumerate(targets.items())})


# Accepted time formats, first match with the best rate wins.
FORMATS = ["dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyyMMddHHmm"]


def strip_weekday(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"\s+(Mo|Di|Mi|Do|Fr|Sa|So)\.?$", ""))


def parse_timestamps(df: DataFrame, source: str, target: str, formats: Sequence[str] = FORMATS, enough: float = 0.7, fallback: float = 0.3) -> DataFrame:
    """The first format that reads more than `enough` of the values; else ISO; else the best format
    above `fallback`. One aggregation decides; unreadable values become null."""
    text = strip_weekday(source)
    reads = {f: F.try_to_timestamp(text, F.lit(f)) for f in formats}
    iso = F.try_to_timestamp(text)
    seen = F.col(source).isNotNull()
    rates = df.agg(
        *(F.avg(F.when(seen, x.isNotNull().cast("double"))).alias(f"f{i}") for i, x in enumerate(reads.values())),
        F.avg(F.when(seen, iso.isNotNull().cast("double"))).alias("iso"),
    ).first()
    by_rate = [(rates[f"f{i}"] or 0.0, f) for i, f in enumerate(formats)]
    chosen = next((f for r, f in by_rate if r > enough), None)
    if chosen is None and (rates["iso"] or 0.0) <= enough:
        best = max(by_rate, key=lambda x: x[0])
        chosen = best[1] if best[0] > max(fallback, rates["iso"] or 0.0) else None
    return df.withColumn(target, reads[chosen] if chosen else iso)


def interpolate(x: Column | str, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear through (xs, ys), constant outside."""
    x = col(x)
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 1, 0, -1):
        a, b, ya, yb = xs[i - 1], xs[i], ys[i - 1], ys[i]
        out = F.when(x < b, F.lit(float(ya)) + (x - a) * ((yb - ya) / (b - a))).otherwise(out)
    return F.when(x <= xs[0], F.lit(float(ys[0]))).otherwise(out)


# Power curves (wind speed in m/s, share of rated power).
ONSHORE = ([0, 3, 5, 8, 12, 25, 26], [0, 0, 0.10, 0.45, 1.0, 1.0, 0])
OFFSHORE = ([0, 3, 5, 8, 11, 14, 25, 26], [0, 0, 0.08, 0.35, 0.75, 1.0, 1.0, 0])


def pv_proxy(irradiance: Column | str, temperature: Column | str) -> Column:
    """Share of rated PV power from global irradiance (W/m2) and air temperature (C)."""
    return F.greatest(F.lit(0.0), col(irradiance) / 1000.0) * clip(1.0 - 0.003 * (col(temperature) - 25.0), 0.75, 1.1)


def wind_proxy(speed: Column | str, offshore: bool = False) -> Column:
    return interpolate(col(speed) * (1.08 if offshore else 1.0), *(OFFSHORE if offshore else ONSHORE))


def array_quantile(sorted_values: Column | str, level: Column | float) -> Column:
    """Linear-interpolation quantile of a sorted array at a level that may come from data."""
    a = col(sorted_values)
    level = level if isinstance(level, Column) else F.lit(level)
    p = (F.size(a) - 1) * clip(level, 0.0, 1.0)
    lo = F.floor(p).cast("int")
    hi = F.least(lo + 1, F.size(a) - 1)
    low = F.try_element_at(a, lo + 1)
    return low + (F.try_element_at(a, hi + 1) - low) * (p - lo)


def order_statistic(sorted_values: Column | str, coverage: Column | float, floor_at: float | None = 0.0) -> Column:
    """The ceil((n + 1) coverage)-th smallest, at most the largest; not below floor_at."""
    a = col(sorted_values)
    coverage = coverage if isinstance(coverage, Column) else F.lit(coverage)
    k = F.greatest(F.lit(1), F.least(F.size(a), F.ceil((F.size(a) + 1) * coverage - 1e-12).cast("int")))
    x = F.try_element_at(a, k)
    return x if floor_at is None else F.greatest(F.lit(floor_at), x)


def easter(year: Column | str) -> Column:
    """Easter Sunday of a Gregorian year (anonymous computus)."""
    y = col(year).cast("int")
    a, b, c = y % 19, F.floor(y / 100), y % 100
    h = (19 * a + b - F.floor(b / 4) - F.floor((b - F.floor((b + 8) / 25) + 1) / 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * F.floor(c / 4) - h - c % 4) % 7
    m = F.floor((a + 11 * h + 22 * k) / 451)
    n = h + k - 7 * m + 114
    return F.make_date(y, F.floor(n / 31).cast("int"), (n % 31 + 1).cast("int"))
