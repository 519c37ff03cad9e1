"""Load series from text files of utilities: separators, preambles, German formats, units.

What a file looks like is decided on its first lines (a bounded peek through Spark's text reader, so
any path that Spark opens works); the rows themselves are parsed by Spark in parallel.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from statistics import mode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import FORMATS, localize, parse_columns, parse_numbers, parse_timestamps, strip_weekday, unit_factor

PEEK = 80
# Words by which header cells are recognised.
TIME_WORDS = re.compile(r"zeit|datum|date|time|timestamp|von|utc", re.I)
VALUE_WORDS = re.compile(r"last|load|leistung|wert|value|kw|mw|reihe|summe|bezug", re.I)
UNIT_WORDS = re.compile(r"\b(kW|MW|GW|W)\b")
LEVEL_WORDS = re.compile(r"kV|ebene|\bNS\b|\bMS\b|\bHS\b", re.I)


@dataclass
class Layout:
    """How a file is laid out: separator, header line number (None: headerless), names, units, levels."""

    separator: str
    header: int | None
    first_row: int
    names: list[str]
    units: dict[str, str] = field(default_factory=dict)
    levels: dict[str, str] = field(default_factory=dict)


def separator(lines: list[str]) -> str:
    """';' if the first non-blank line has at least as many of them as commas."""
    line = next((x for x in lines if x.strip()), "")
    return ";" if line.count(";") >= line.count(",") else ","


def _is_data(cells: list[str]) -> bool:
    return len(cells) >= 4 and bool(re.fullmatch(r"\d{1,2}\.\d{1,2}\.\d{2,4}", cells[0].strip())) and all(re.fullmatch(r"\d{1,2}:\d{2}(:\d{2})?", c.strip()) for c in cells[1:3])


def sniff(lines: list[str]) -> Layout:
    """Layout from the first lines: a header names a time and a value, or is the first line as wide as most are; a headerless file has date, from and
    to first, and its columns are named Datum, von, bis, Load_1, ... with units and levels from
    the lines above."""
    sep = separator(lines)
    for k, line in enumerate(lines):
        cells = [c.strip().strip('"') for c in line.split(sep)]
        if _is_data(cells):
            names = ["Datum", "von", "bis", *(f"Load_{i}" for i in range(1, len(cells) - 2))]
            out = Layout(sep, None, k, names)
            for above in lines[:k]:
                for name, cell in zip(names, above.split(sep)):
                    if name.startswith("Load_"):
                        if m := UNIT_WORDS.search(cell):
                            out.units[name] = m[1]
                        if LEVEL_WORDS.search(cell):
                            out.levels[name] = cell.strip()
            return out
        if len(cells) >= 2 and any(TIME_WORDS.search(c) for c in cells) and any(VALUE_WORDS.search(c) and not TIME_WORDS.search(c) for c in cells):
            names = [c or f"c{i}" for i, c in enumerate(cells)]
            units = {n: m[1] for n in names if (m := UNIT_WORDS.search(n))}
            return Layout(sep, k, k + 1, names, units)
    # no words that are known: the first line with as many cells as most lines have
    widths = [line.count(sep) for line in lines if sep in line]
    k = next((k for k, line in enumerate(lines) if line.count(sep) == mode(widths)), 0) if widths else 0
    names = [c.strip().strip('"') or f"c{i}" for i, c in enumerate(lines[k].split(sep))] if lines else []
    return Layout(sep, k, k + 1, names, {n: m[1] for n in names if (m := UNIT_WORDS.search(n))})


def is_excel(head: bytes, path: str = "") -> bool:
    return head[:2] == b"PK" or head[:4] == b"\xd0\xcf\x11\xe0" or path.lower().endswith((".xls", ".xlsx"))


def read_text(spark: SparkSession, path: str, encoding: str = "UTF-8") -> tuple[DataFrame, Layout]:
    """All cells as text under the sniffed names, with `line`, the row's order in the file."""
    lines = spark.read.option("encoding", encoding).text(path)
    head = lines.select(F.substring(F.col("value").cast("binary"), 1, 8)).first()  # not as one binary value: files may be larger than a task
    if head is not None and is_excel(bytes(head[0]), path):
        raise ValueError("Excel files need a reader package that isn't installed; export the sheet as CSV")
    layout = sniff([r["value"] for r in lines.limit(PEEK).collect()])
    numbered = lines.withColumn("line", F.monotonically_increasing_id())
    rows = numbered.where(F.col("line") >= layout.first_row)  # the first lines of the file are the first of the first split
    cells = F.split("value", re.escape(layout.separator), -1)
    rows = rows.where(F.trim("value") != "").withColumn("cells", cells)
    named = [F.trim(F.regexp_replace(F.get("cells", F.lit(i)), '^"|"$', "")).alias(n) for i, n in enumerate(layout.names)]
    return rows.select("line", *named), layout


def index_like(df: DataFrame, column: str) -> Column:
    """An aggregate: the column is an arithmetic progression with a step of at least 1."""
    return (F.min(column) == F.max(column)) & (F.abs(F.min(column)) >= 1)


def inspect(df: DataFrame, columns: list[str], rows: int = 2000) -> DataFrame:
    """Profile of candidate load columns on the first rows: (column, rate, n, mean, min, max, std, index_like,
    plausible). The limit is the feature: a quick look, in two aggregations whatever the number of columns."""
    text, value, step = ([f"{x}{k}" for k in range(len(columns))] for x in "tvs")
    head = df.orderBy("line").limit(rows).select("line", *(F.col(c).alias(t) for c, t in zip(columns, text)))
    x = parse_columns(head, dict(zip(text, value)))
    x = x.withColumns({s: F.col(v) - F.lag(v).over(W.orderBy("line")) for v, s in zip(value, step)})
    profiles = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(F.col(v).isNotNull().cast("double")).alias("rate"),
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.stddev_pop(v).alias("std"),
            (index_like(x, s) & (F.count(v) >= 5)).alias("index_like"),
        )
        for c, v, s in zip(columns, value, step)
    ]
    out = x.agg(F.array(*profiles).alias("profiles")).select(F.inline("profiles"))
    good = (F.col("rate") > 0.5) & ~F.coalesce("index_like", F.lit(False)) & (F.col("std") > 0)
    return out.withColumn("plausible", F.coalesce(good, F.lit(False)))


def time_column(df: DataFrame, columns: list[str], rows: int = 2000, least: float = 0.5) -> str:
    """The column whose values on the first rows are times most often, under the format that reads it best; ties go to a
    name that sounds like a time, then to the first. The limit is the feature: a quick look, in one aggregation."""
    head = df.orderBy("line").limit(rows)
    reads = {c: [F.try_to_timestamp(strip_weekday(c), F.lit(f)) for f in FORMATS] + [F.when(F.col(c).rlike(r"\d[-/.:]"), F.try_to_timestamp(strip_weekday(c)))] for c in columns}
    filled = {c: F.trim(c) != "" for c in columns}
    rates = head.agg(*(F.greatest(*(F.avg(F.when(filled[c], x.isNotNull().cast("double"))) for x in parsed)).alias(f"r{k}") for k, (c, parsed) in enumerate(reads.items()))).first()
    best = max(range(len(columns)), key=lambda k: (round(rates[f"r{k}"] or 0.0, 9), bool(TIME_WORDS.search(columns[k])), -k))
    if (rates[f"r{best}"] or 0.0) < least:
        raise ValueError(f"no column holds times; name it: {columns}")
    return columns[best]


def load_series(
    spark: SparkSession, path: str, series_id: str, ts_col: str | None = None, load_col: str | None = None, unit: str | None = None, zone: str = "Europe/Berlin"
) -> DataFrame:
    """(series_id, ts UTC, value MW) by the hour from a utility's file. The load column must be named if
    several are plausible. Repeated times keep the first; the second of a repeated autumn hour is
    standard time."""
    cells, layout = read_text(spark, path)
    if ts_col is None:
        ts_col = "Datum" if {"Datum", "von"} <= set(layout.names) else time_column(cells, layout.names)
    stamped = cells
    if ts_col == "Datum" and "von" in layout.names:
        stamped = cells.withColumn("_ts", F.concat_ws(" ", "Datum", "von"))
    else:
        stamped = cells.withColumn("_ts", F.col(ts_col))
    if load_col is None:
        seen = inspect(cells, [n for n in layout.names if n not in {ts_col, "Datum", "von", "bis"}]).where("plausible").collect()
        if len(seen) != 1:
            raise ValueError(f"name the load column; plausible: {[r['column'] for r in seen]}")
        load_col = seen[0]["column"]
    factor = unit_factor(F.lit(unit or layout.units.get(load_col, "MW")))
    x = parse_timestamps(stamped, "_ts", "local")
    x = parse_numbers(x, load_col, "_v").where("local is not null and _v is not null")
    again = F.row_number().over(W.partitionBy("local").orderBy("line"))
    utc = localize("local", again > 1, zone)
    x = x.withColumn("ts", utc).withColumn("k", F.row_number().over(W.partitionBy("ts").orderBy("line"))).where("k = 1")
    hourly = x.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg(F.col("_v") * factor).alias("value"))
    return hourly.select(F.lit(series_id).alias("series_id"), "ts", "value")
