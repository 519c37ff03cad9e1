"""EDIFACT MSCONS: metered values as (message file, ts, value, unit, obis, qualifier, known).

The end sign of segments is the record separator, so a large file is read in splits. Windows inside a split, and a row a
split carried to the next, tell which records go on after a quoted end sign, where line items begin and what OBIS code holds;
line items are then independent, and their segments pass in order through a small state machine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.relations import _cut

# Separators that hold without a UNA segment, energy units, known QTY qualifiers.
DEFAULT = ":+.? '"
KNOWN = {"220", "67", "201", "187"}
SCHEMA = "file string, start_text string, start_format string, end_text string, end_format string, pos int, n int, value double, unit string, obis string, qualifier string, known boolean"
ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]]) for c in SCHEMA.split(", ")])
BATCH = 8192  # values of one batch


def segments(text: str, signs: str | None = None) -> Iterator[list[list[str]]]:
    """Segments as lists of elements of components; the release character quotes the next one. Without signs, those of the
    text's UNA segment hold."""
    if signs is None:
        signs = DEFAULT
        if text.startswith("UNA") and len(text) >= 9:
            signs, text = text[3:9], text[9:]
    component, element, _, release, _, end = signs
    out: list[list[str]] = [[""]]
    quoted = False
    for c in text:
        if quoted:
            out[-1][-1] += c
            quoted = False
        elif c == release and release != " ":
            quoted = True
        elif c == end:
            if any(any(x) for x in out):
                yield out
            out = [[""]]
        elif c == element:
            out.append([""])
        elif c == component:
            out[-1].append("")
        elif c not in "\r\n":
            out[-1][-1] += c
    if any(any(x) for x in out):
        yield out


class LineItem:
    """Values and periods of one line item, from its segments in order. A period with one value is an interval; with several
    the values divide it evenly. feed() returns the rows of a period that is over, flush() those of the last one."""

    def __init__(self) -> None:
        self.start = self.end = None
        self.held: list[tuple] = []
        self.times_first = False  # whether the period's times came before its values

    def flush(self) -> list[tuple]:
        start, end = self.start or (None, None), self.end or (None, None)
        out = [(*start, *end, k, len(self.held), *x, x[2] in KNOWN) for k, x in enumerate(self.held)]
        self.held = []
        return out

    def feed(self, seg: list[list[str]]) -> list[tuple]:
        tag, out = seg[0][0], []
        if tag in ("PIA", "LIN"):
            out = self.flush()
            self.start = self.end = None
        elif tag == "QTY":
            if self.held and self.start and self.end and not self.times_first:  # values, then times: the period is complete
                out = self.flush()
                self.start = self.end = None
            if not self.held:
                self.times_first = self.start is not None
            try:
                c = seg[1]
                self.held.append((float(c[1]), c[2] if len(c) > 2 else None, c[0]))
            except (IndexError, ValueError):
                pass
        elif tag == "DTM" and len(seg) > 1 and len(seg[1]) > 1:
            code, at = seg[1][0], (seg[1][1], seg[1][2] if len(seg[1]) > 2 else "203")
            if code == "163":
                if self.held and self.times_first:  # the next period begins
                    out, self.end = self.flush(), None
                self.start = at
            elif code == "164":
                self.end = at
        return out


def obis_of(pia: str | None, signs: str) -> str | None:
    """The code in the third element of a PIA segment."""
    seg = next(segments(pia, signs), []) if pia is not None else []
    return ":".join(seg[2][:2]).rstrip(":") if len(seg) > 2 else None


def line_items(rows: Iterator[tuple], signs: str) -> Iterator[tuple]:
    """Rows of SCHEMA from (file, item, pia, starts, record), each item's records together and in order. Only the values of one
    period are held."""
    end, key, obis, item, text = signs[5], None, None, LineItem(), None

    def told(found: list[tuple]) -> Iterator[tuple]:
        for *head, value, unit, qualifier, known in found:
            yield (key[0], *head, value, unit, obis, qualifier, known)

    def closed() -> Iterator[tuple]:
        for seg in segments(text, signs):
            yield from told(item.feed(seg))

    for file, number, pia, starts, record in rows:
        if (file, number) != key:
            if text is not None:
                yield from closed()
                yield from told(item.flush())
            key, obis, item, text = (file, number), obis_of(pia, signs), LineItem(), None
        if starts and text is not None:
            yield from closed()
            text = None
        text = record if text is None else f"{text}{end}{record}"
    if text is not None:
        yield from closed()
        yield from told(item.flush())


def service_signs(spark: SparkSession, path: str) -> DataFrame:
    """(file, signs) of the files that begin with a UNA segment. The digit 0 separates the records of this scan: it is no sign,
    and files of measured values are full of it, so no record is long whatever signs a file has."""
    x = spark.read.option("lineSep", "0").text(path).where(F.col("_metadata.file_block_start") == 0)
    x = x.select(F.col("_metadata.file_path").alias("file"), F.substring("value", 1, 9).alias("head"), F.monotonically_increasing_id().alias("id"))
    first = x.groupBy("file").agg(F.min_by("head", "id").alias("head"))
    return first.where(F.col("head").startswith("UNA") & (F.length("head") == 9)).select("file", F.substring("head", 4, 6).alias("signs"))


def _carried(rows: DataFrame, **last: Column) -> DataFrame:
    """(file, split, ...): of each column the last value that isn't null in the file's splits before; one row a split."""
    of = rows.groupBy("file", "split").agg(*(F.max(F.when(v.isNotNull(), F.struct("id", v.alias("v")))).alias(k) for k, v in last.items()))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    return of.select("file", "split", *(F.last(F.col(k)["v"], ignorenulls=True).over(earlier).alias(k) for k in last))


def _numbered(records: DataFrame, signs: str) -> DataFrame:
    """(file, item, pia, starts, split, id, value) of the records of values, times and line items: item counts the line items of
    the file, pia is the last PIA segment with a code."""
    component, element, _, release, _, _ = signs
    quote = re.escape(release)
    bare = F.translate("value", "\r\n", "")
    tag = F.when(F.substring(bare, 4, 1).isin(element, component, ""), F.substring(bare, 1, 3)).otherwise("")
    goes_on, plain = F.lit(False), bare
    if release != " ":  # an odd number of release characters at the end quotes the end sign
        goes_on = F.length(F.regexp_extract("value", rf"((?:{quote})*)\z", 1)) % 2 == 1
        plain = F.regexp_replace(bare, rf"(?s){quote}.", "")
    coded = F.length(plain) - F.length(F.translate(plain, element, "")) >= 2
    in_split = W.partitionBy("file", "split").orderBy("id")
    known = records.withColumns({"tag": tag, "goes_on": goes_on, "coded": coded & (tag == "PIA")})
    known = _cut(known.withColumn("after", F.lag("goes_on").over(in_split)))
    x = known.join(_carried(known, ended=F.col("goes_on")), ["file", "split"])
    x = x.withColumn("starts", ~F.coalesce("after", "ended", F.lit(False)))
    x = x.withColumn("begins", F.col("starts") & F.col("tag").isin("LIN", "PIA"))
    whose, code = F.when(F.col("starts"), F.col("tag")), F.when(F.col("starts") & F.col("coded"), F.col("value"))
    counts = x.groupBy("file", "split").agg(F.count_if("begins").alias("n"))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("items"))
    x = x.join(counts, ["file", "split"]).join(_carried(x, tag_before=whose, pia_before=code), ["file", "split"])
    so_far = in_split.rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumns({
        "item": F.col("items") + F.sum(F.col("begins").cast("long")).over(so_far),
        "whose": F.coalesce(F.last(whose, ignorenulls=True).over(so_far), "tag_before"),
        "pia": F.coalesce(F.last(code, ignorenulls=True).over(so_far), "pia_before"),
    })
    return x.where(F.col("whose").isin("LIN", "PIA", "QTY", "DTM")).select("file", "item", "pia", "starts", "split", "id", "value")


def _values(records: DataFrame, signs: str) -> DataFrame:
    """Rows of SCHEMA from records(file, split, id, value) of files with these signs. Files and splits are no unit of work here:
    line items are dealt to tasks, and each passes as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "item", "pia", "starts", "value"))))
        held: list[tuple] = []
        for row in line_items(rows, signs):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), ARROW)], schema=ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), ARROW)], schema=ARROW)

    return _numbered(records, signs).repartition("file", "item").sortWithinPartitions("file", "item", "split", "id").mapInArrow(run, SCHEMA)


def stamp(text, form):
    """UTC time of formats 102 (date), 203 (minutes), 303 (minutes and zone offset in hours)."""
    raw = F.regexp_extract(text, r"^(\d{8,12})", 1)
    local = F.try_to_timestamp(F.rpad(raw, 12, "0"), F.lit("yyyyMMddHHmm"))
    offset = F.regexp_extract(text, r"\?*([+-]\d{2})$", 1).try_cast("int")
    zoned = local - F.make_dt_interval(hours=offset)
    return F.when(form == "303", F.coalesce(zoned, F.to_utc_timestamp(local, "Europe/Berlin"))).otherwise(F.to_utc_timestamp(local, "Europe/Berlin"))


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA of every value in the files of a path. Files are read once for each set of signs among them, of which there
    are few. A PIA segment's code is read up to a quoted end sign."""
    own = _cut(service_signs(spark, path).where(F.col("signs") != DEFAULT))
    every = [r["signs"] for r in own.select("signs").distinct().collect()]
    parts = []
    for signs in [DEFAULT, *sorted(every)]:
        x = spark.read.option("lineSep", signs[5]).text(path)
        x = x.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
        if every:
            x = x.join(own.select("file"), "file", "left_anti") if signs == DEFAULT else x.join(own.where(F.col("signs") == signs).select("file"), "file", "left_semi")
        x = x.where(~((F.col("split") == 0) & F.col("value").startswith("UNA") & (F.length("value") == 8)))
        parts.append(_values(x, signs))
    return reduce(DataFrame.unionByName, parts)


def read_mscons(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, step_h, value, unit, obis, qualifier, known) of every value in the files of a path."""
    x = read_values(spark, path)
    start, end = stamp(F.col("start_text"), F.col("start_format")), stamp(F.col("end_text"), F.col("end_format"))
    x = x.withColumn("a", start).withColumn("b", end)
    seconds = (F.unix_timestamp("b") - F.unix_timestamp("a")) / F.col("n")
    step = F.coalesce(seconds, F.lit(900.0))
    ts = F.timestamp_seconds(F.unix_timestamp("a") + F.col("pos") * step)
    return x.select("file", ts.alias("ts"), (step / 3600).alias("step_h"), "value", "unit", "obis", "qualifier", "known").where("ts is not null")


def hourly_power(values: DataFrame, unit_hint: str = "KWH") -> DataFrame:
    """(ts, value MW): energy over its step, power as it is, unknown units by the hint; hourly means."""
    from ..functions.columns import ENERGY_TO_MWH, unit_factor

    unit = F.upper(F.coalesce("unit", F.lit(unit_hint)))
    energy, power = unit_factor(unit, ENERGY_TO_MWH), unit_factor(unit)
    hint = ENERGY_TO_MWH.get(unit_hint.upper(), 1.0)
    mw = F.coalesce(F.col("value") * energy / F.col("step_h"), F.col("value") * power, F.col("value") * hint / F.col("step_h"))
    return values.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg(mw).alias("value"))
