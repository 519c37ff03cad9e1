"""Time-series services as Spark data sources: one partition per chunk, chunks pruned by range.

The transport is a function, so a test (or a box without a network) passes its own. Registered
names: spark.dataSource.register(ChunkedSeries); spark.read.format("chunked_series").
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

WEEK_MS = 7 * 24 * 3600 * 1000


def http_get(url: str) -> str:
    from urllib.request import urlopen

    with urlopen(url, timeout=60) as r:
        return r.read().decode()


def _transport(name: str | None):
    """A function by its dotted name, e.g. my.module.get."""
    if not name:
        return http_get
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


class Pruned(DataSourceReader):
    """A reader that learns from filters on one column between which values rows can be, and leaves out partitions beyond. All
    filters stay with Spark, so what is read too much does no harm. Spark hands filters on only where
    spark.sql.python.filterPushdown.enabled is true, and refuses readers that take them elsewhere: option prune = true asks for it."""

    column, low, high = "ts", None, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != (self.column,):
                continue
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self._at_least(f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self._at_most(f.value)
            elif isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self._at_least(f.value)
                self._at_most(f.value)
            elif isinstance(f, In) and f.value:
                self._at_least(min(f.value))
                self._at_most(max(f.value))
        return filters

    def _at_least(self, value) -> None:
        self.low = value if self.low is None else max(self.low, value)

    def _at_most(self, value) -> None:
        self.high = value if self.high is None else min(self.high, value)

    def days(self) -> tuple[date | None, date | None]:
        """The bounds as days, a day wider on each side, whatever their time zone."""
        one = timedelta(days=1)
        day = lambda v: v.date() if isinstance(v, datetime) else v if isinstance(v, date) else datetime.fromisoformat(str(v)[:10]).date()
        return (None if self.low is None else day(self.low) - one), (None if self.high is None else day(self.high) + one)


def _reader(kind: type, options: dict, *more):
    """kind, which takes filters only where that is asked for."""
    if options.get("prune", "").lower() == "true":
        kind = type(f"Pruned{kind.__name__}", (kind, Pruned), {})
    return kind(options, *more)


def _days(reader) -> tuple[date | None, date | None]:
    return reader.days() if isinstance(reader, Pruned) else (None, None)


def _meets(reader, first: date, last: date) -> bool:
    """Whether days first to last can hold rows that the filters let through."""
    low, high = _days(reader)
    return (low is None or last >= low) and (high is None or first <= high)


class Chunk(InputPartition):
    def __init__(self, url: str, low: int, high: int):
        self.url, self.low, self.high = url, low, high


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Chunk]:
        o = self.options
        low, high = int(o["start_ms"]), int(o["end_ms"])
        since, until = _days(self)
        ms = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=timezone.utc).timestamp() * 1000)
        low = low if since is None else max(low, ms(since))
        high = high if until is None else min(high, ms(until + timedelta(days=1)))
        stamps = json.loads(_transport(o.get("transport"))(o["index"]))["timestamps"]
        return [Chunk(o["chunk"].format(ts=t), low, high) for t in stamps if low - WEEK_MS <= t <= high]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        seen = set()
        for ms, value in json.loads(_transport(self.options.get("transport"))(partition.url))["series"]:
            if value is not None and partition.low <= ms < partition.high and ms not in seen:
                seen.add(ms)
                yield datetime.fromtimestamp(ms / 1000, timezone.utc), float(value)


class ChunkedSeries(DataSource):
    """Options: index and chunk (URL with {ts}), start_ms, end_ms, transport (dotted function name), prune (chunks by filters on ts)."""

    @classmethod
    def name(cls) -> str:
        return "chunked_series"

    def schema(self) -> str:
        return "ts timestamp, value double"

    def reader(self, schema) -> ChunkReader:
        return _reader(ChunkReader, dict(self.options))


class Span(InputPartition):
    def __init__(self, url: str):
        self.url = url


class WeatherReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self) -> list[Span]:
        o = self.options
        day, end, step = datetime.fromisoformat(o["start"]), datetime.fromisoformat(o["end"]), timedelta(days=int(o.get("chunk_days", 180)))
        out = []
        while day <= end:
            last = min(end, day + step - timedelta(days=1))
            if not _meets(self, day.date(), last.date()):
                day = last + timedelta(days=1)
                continue
            out.append(Span(o["url"].format(start=day.date(), end=last.date(), hourly=",".join(self.columns))))
            day = last + timedelta(days=1)
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        hourly = json.loads(_transport(self.options.get("transport"))(partition.url))["hourly"]
        for row in zip(hourly["time"], *(hourly[c] for c in self.columns)):
            yield (datetime.fromisoformat(row[0]).replace(tzinfo=timezone.utc), *(None if v is None else float(v) for v in row[1:]))


class ForecastWeather(DataSource):
    """Historical forecasts, never reanalysis. Options: url with {start}, {end}, {hourly}; columns; start; end;
    chunk_days; transport; prune (spans by filters on ts)."""

    @classmethod
    def name(cls) -> str:
        return "forecast_weather"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")]

    def schema(self) -> str:
        return "ts timestamp, " + ", ".join(f"{c} double" for c in self._columns())

    def reader(self, schema) -> WeatherReader:
        return _reader(WeatherReader, dict(self.options), self._columns())


class Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, fields: list[str]):
        self.options, self.fields = options, fields

    def partitions(self) -> list[Page]:
        """One partition a month of [start, end]; pages of a month are read in turn, as only the last tells that it is."""
        o = self.options
        day, end = datetime.fromisoformat(o["start"]), datetime.fromisoformat(o["end"])
        out = []
        while day <= end:
            following = (day.replace(day=1) + timedelta(days=32)).replace(day=1)
            if not _meets(self, day.date(), following.date()):
                day = following
                continue
            out.append(Page(o["url"].replace("{start}", str(day.date())).replace("{end}", str(min(end + timedelta(days=1), following).date()))))
            day = following
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        get, limit, offset = _transport(self.options.get("transport")), int(self.options.get("limit", 100)), 0
        while True:
            found = json.loads(get(partition.url.replace("{limit}", str(limit)).replace("{offset}", str(offset))))["results"]
            for r in found:
                yield tuple(None if r.get(f) is None else str(r[f]) for f in self.fields)
            offset += len(found)
            if len(found) < limit:
                return


class PagedRecords(DataSource):
    """Open-data record services: options url with {start}, {end} (exclusive), {limit}, {offset}; fields; start; end;
    limit; transport; prune (months by filters on date_field, an ISO date as text). All fields are text, for the parsers
    of this package."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def _fields(self) -> list[str]:
        return [f.strip() for f in self.options["fields"].split(",")]

    def schema(self) -> str:
        return ", ".join(f"`{f}` string" for f in self._fields())

    def reader(self, schema) -> RecordReader:
        reader = _reader(RecordReader, dict(self.options), self._fields())
        reader.column = self.options.get("date_field", "ts")
        return reader


def cached(spark: SparkSession, path: str, read: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What read() gives, kept as Parquet at path: read again only if forced or not there."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    read().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def national_load(spark: SparkSession, path: str, countries: list[str]) -> DataFrame:
    """Tab-separated national hourly loads (CountryCode, DateUTC dd-MM-yyyy HH:mm, Value, Cov_ratio) -> (series_id, ts, value
    MW, coverage); a country without rows is an error."""
    raw = spark.read.options(sep="\t", header=True).csv(path).where(F.col("CountryCode").isin(countries))
    out = raw.select(
        F.col("CountryCode").alias("series_id"), F.try_to_timestamp("DateUTC", F.lit("dd-MM-yyyy HH:mm")).alias("ts"), F.col("Value").try_cast("double").alias("value"), F.col("Cov_ratio").try_cast("double").alias("coverage")
    )
    missing = set(countries) - {r[0] for r in out.select("series_id").distinct().collect()}  # at most the countries asked for
    if missing:
        raise ValueError(f"no rows of {sorted(missing)}")
    return out


def register(spark: SparkSession) -> None:
    for source in (ChunkedSeries, ForecastWeather, PagedRecords):
        spark.dataSource.register(source)


def read_weekly_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of [[epoch ms, MW], ...] -> (ts, value), nulls and repeated times dropped (smallest value first)."""
    x = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "array<array<double>>")).alias("p"))
    x = x.select(F.timestamp_millis(F.col("p")[0].cast("long")).alias("ts"), F.col("p")[1].alias("value")).where("value is not null")
    return x.groupBy("ts").agg(F.min("value").alias("value"))


def half_hours_to_mw(df: DataFrame) -> DataFrame:
    """(ts, area, wh per half hour) -> (ts, value MW): sum over areas; Wh / 500 000 is MW."""
    return df.groupBy("ts").agg((F.sum("wh") / 500_000).alias("value"))
