"""Readers on files that are written from the driver tables first, a file a series, and correctors and requests that users bring.

Files go to the shared scratch folder; each is written by one task, as a file has one order.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import models, relations, studies
from ..sources import catalog, mscons, prices, remote, text_series
from . import inputs as i
from . import service
from .registry import query, rounded
from .support_queries import BASE_FIT

START = "TIMESTAMP '2024-01-01'"


def _files(*lines: DataFrame) -> str:
    """lines(name, k, line) as text files in order of k, below the folder returned: name=<name>/part-..., one file a name."""
    root = f"{relations._scratch(lines[0].sparkSession)}/files-{uuid.uuid4().hex}"
    relations.dealt_union(["name"], *lines).sortWithinPartitions("name", "k").select("name", "line").write.partitionBy("name").text(root)
    return root


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    """Events by the second: name, ts, event_id, value."""
    e = i.table(spark, d, "events")
    return e.select(F.col("event_type").alias("name"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), "event_id", "value")


STAMPED = "stamped AS (SELECT event_type AS name, date_trunc('second', ts) AS ts, event_id, value FROM events)"


def _csv(spark: SparkSession, d: str) -> list[tuple[Column, str]]:
    """Each event type as a utility's file: two lines before the header, a row number, times in German form with the day of the week, a
    note without numbers; the load in kW with German numbers. Returns the types with the folders of their files, which are named by
    the type's bytes: it may be null or hold what paths don't."""
    e = _stamped(spark, d)
    german = F.translate(F.format_number("value", 3), ",.", ".,")
    day = F.element_at(F.array(*(F.lit(x) for x in ("Mo", "Di", "Mi", "Do", "Fr", "Sa", "So"))), F.weekday("ts") + 1)
    k = F.row_number().over(Window.partitionBy("name").orderBy("ts", "event_id"))
    rows = e.withColumn("k", k).withColumn("line", F.concat_ws(";", "k", F.concat(F.lit("Messung "), F.col("event_id") % 3), german, F.concat_ws(" ", F.date_format("ts", "dd.MM.yyyy HH:mm:ss"), day)))
    names = e.select("name").distinct()
    key = F.coalesce(F.concat(F.lit("x"), F.hex("name")), F.lit("null"))
    heads = names.select(key.alias("name"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).alias("line")) for k, x in ((-2, "Bericht"), (-1, ""), (0, "nr;Notiz;Leistung [kW];Stempel"))))).alias("h"))
    root = _files(rows.select(key.alias("name"), "k", "line"), heads.select("name", "h.k", "h.line"))
    return [(F.lit(r["name"]).cast("string"), f"{root}/name={r['key']}") for r in names.select("name", key.alias("key")).orderBy("key").collect()]  # one row an event type


@query(f"""WITH {STAMPED}, once AS (SELECT *, row_number() OVER (PARTITION BY name, ts ORDER BY event_id) AS k FROM stamped)
SELECT name AS series_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS ts, round(avg(round(value, 3)) / 1000, 9) AS value FROM once
  WHERE k = 1 GROUP BY ALL""")
def csv_files(spark: SparkSession, d: str) -> DataFrame:
    """Separator, preamble, header, time column, load column and unit are found out from each file."""
    out = [text_series.load_series(spark, path, "", zone="UTC").withColumn("series_id", name) for name, path in _csv(spark, d)]
    return rounded(relations.dealt_union(["series_id"], *out).withColumn("ts", i.stamp("ts")), digits=9)


@query(f"""WITH {STAMPED}, f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, event_id) AS nr FROM stamped),
h AS (SELECT * FROM f WHERE nr <= 2000)
SELECT name, 'Leistung' AS "column", count(*) AS n, round(avg(round(value, 3)), 6) AS mean, round(min(value), 3) AS min, round(max(value), 3) AS max, true AS plausible FROM h GROUP BY 1
UNION ALL SELECT name, 'nr', count(*), avg(nr), min(nr), max(nr), false FROM h GROUP BY 1
UNION ALL SELECT name, 'Notiz', 0, NULL, NULL, NULL, false FROM h GROUP BY 1""")
def csv_inspection(spark: SparkSession, d: str) -> DataFrame:
    """What the first 2 000 rows of each file say about its columns: the row number is index-like, the note holds no numbers."""
    out = []
    for name, path in _csv(spark, d):
        cells, layout = text_series.read_text(spark, path)
        x = text_series.inspect(cells, [c for c in layout.names if c != "Stempel"])
        out.append(x.select(name.alias("name"), F.when(F.col("column").startswith("Leistung"), "Leistung").otherwise(F.col("column")).alias("column"), "n", "mean", "min", "max", "plausible"))
    return rounded(relations.dealt_union(["name"], *out))


@query("""SELECT epoch_us(ts) // 1000 AS ms, round(min(value), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY 1""")
def json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """A file of [[milliseconds, value], ...] for each day."""
    e = i.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    pair = F.concat(F.lit("["), F.unix_millis("ts"), F.lit(","), F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit("]"))
    day = e.withColumn("pair", pair).groupBy(F.date_format("ts", "yyyyMMdd").alias("name")).agg(F.collect_list("pair").alias("p"))
    root = _files(day.select("name", F.lit(0).alias("k"), F.concat(F.lit("["), F.array_join("p", ","), F.lit("]")).alias("line")))
    return rounded(remote.read_weekly_json(spark, root).select(F.unix_millis("ts").alias("ms"), "value"))


def _price_files(spark: SparkSession, d: str, column: str) -> tuple[str, list[str]]:
    p = i.table(spark, d, "part")
    zeit = F.concat(F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("p_partkey").cast("int")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00"))
    price = F.when(F.col("p_partkey") % 13 == 0, "").otherwise(F.translate(F.format_number(F.col("p_retailprice") - 1000, 2), ",.", ".,"))
    rows = p.select(F.translate(F.substring("p_brand", 1, 7), "#", "").alias("name"), (F.col("p_partkey") + 1).cast("int").alias("k"), F.concat_ws(";", zeit, price).alias("line"))
    names = rows.select("name").distinct()
    heads = names.select("name", F.lit(-1).alias("k"), F.lit(f"Zeit;{column}").alias("line"))
    return _files(rows, heads), sorted(r["name"] for r in names.collect())  # one name for each first digit of a brand


PRICES = f"""p AS (SELECT replace(substr(p_brand, 1, 7), '#', '') AS name, row_number() OVER (PARTITION BY substr(p_brand, 1, 7) ORDER BY p_partkey) - 1 AS pos,
  {START} + INTERVAL (p_partkey) HOUR - INTERVAL 1 HOUR AS ts, CASE WHEN p_partkey % 13 <> 0 THEN round(p_retailprice - 1000, 2) END AS price FROM part)"""


@query(f"WITH {PRICES} SELECT name, pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, price FROM p WHERE price IS NOT NULL")
def rebap_files(spark: SparkSession, d: str) -> DataFrame:
    """Imbalance price files; gaps go, positions stay those of the file."""
    root, names = _price_files(spark, d, "reBAP_EUR_MWh")
    out = [prices.read_prices(spark, f"{root}/name={n}").select(F.lit(n).alias("name"), F.col("pos").cast("long").alias("pos"), i.stamp("ts").alias("ts"), "price") for n in names]
    return relations.dealt_union(["name"], *out)


@query(f"WITH {PRICES} SELECT name, count(*) AS n, count(price) AS n_known, round(avg(price), 6) AS mean FROM p GROUP BY 1")
def spot_files(spark: SparkSession, d: str) -> DataFrame:
    """Spot price files with their gaps."""
    root, names = _price_files(spark, d, "spot_DA_EUR_MWh")
    out = [prices.read_prices(spark, f"{root}/name={n}", keep_gaps=True).withColumn("name", F.lit(n)) for n in names]
    x = relations.dealt_union(["name"], *out).groupBy("name")
    return rounded(x.agg(F.count("*").alias("n"), F.count("price").alias("n_known"), F.avg("price").alias("mean")))


def _messages(spark: SparkSession, d: str) -> str:
    """Each event type's hours as a message of single values; a release character stands before each +."""
    x = i.load(spark, d).where("value > 0")
    at = lambda h: F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(h)), "yyyyMMddHHmm")
    line = F.concat(F.lit("QTY+220:"), F.format_string("%.3f", "value"), F.lit(":KWH'DTM+163:"), at(0), F.lit("?+00:303'DTM+164:"), at(1), F.lit("?+00:303'"))
    rows = x.select(F.col("series_id").alias("name"), F.unix_timestamp("ts").alias("k"), line.alias("line"))
    heads = rows.select("name").distinct().select("name", F.lit(-1).cast("long").alias("k"), F.lit("UNB+UNOC:3'LIN+1'PIA+5+1-1?:1.8.0:SRW'").alias("line"))
    return _files(rows, heads)


@query(f"""WITH {i.LOAD} SELECT series_id AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 1.0::DOUBLE AS step_h, round(value, 3) AS value, 'KWH' AS unit
  FROM load WHERE value > 0""")
def mscons_values(spark: SparkSession, d: str) -> DataFrame:
    x = mscons.read_mscons(spark, _messages(spark, d))
    return x.select(F.regexp_extract("file", "name=([^/]+)", 1).alias("name"), i.stamp("ts").alias("ts"), "step_h", F.round("value", 3).alias("value"), "unit")


@query(f"""WITH {i.LOAD} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(avg(round(value, 3)) / 1000, 9) AS value FROM load WHERE value > 0 GROUP BY 1""")
def mscons_power(spark: SparkSession, d: str) -> DataFrame:
    """Energies of an hour as power, the mean over the files."""
    return rounded(mscons.hourly_power(mscons.read_mscons(spark, _messages(spark, d))).withColumn("ts", i.stamp("ts")), digits=9)


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def cached_views(spark: SparkSession, d: str) -> DataFrame:
    """Tables kept as Parquet and views, then plain SQL."""
    root = f"{relations._scratch(spark)}/views-{uuid.uuid4().hex}"
    catalog.cache_views(spark, {f"kept_{t}": i.table(spark, d, t) for t in ("orders", "customer")}, root)
    x = spark.sql("select o_orderpriority as priority, count(*) as n, sum(o_totalprice) as total from kept_orders join kept_customer on o_custkey = c_custkey group by 1")
    return rounded(x, "total", digits=2)


@query("SELECT 'n' || n_nationkey AS key, n_name AS name, 'kW' AS unit, n_nationkey % 2 = 0 AS signed FROM nation WHERE n_nationkey % 5 <> 3")
def manifest_entries(spark: SparkSession, d: str) -> DataFrame:
    """Nations as entries of a manifest a region; some say that they take no part, some say nothing."""
    n = i.table(spark, d, "nation")
    entry = F.to_json(F.struct(
        F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("kW").alias("unit"), (F.col("n_nationkey") % 2 == 0).alias("signed"),
        F.when(F.col("n_nationkey") % 5 == 3, False).when(F.col("n_nationkey") % 5 == 1, True).alias("include_in_benchmark"),
    ))
    lists = n.groupBy(F.col("n_regionkey").cast("string").alias("name")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ",\n"), F.lit("]")).alias("line"))
    root = _files(lists.withColumn("k", F.lit(0)))
    return catalog.read_manifest(spark, f"{root}/*").select("key", "name", "unit", "signed")


class MeanCorrector:
    """A corrector that a user brings: the mean of what it has seen."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean = float(np.mean(y))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.mean)


MEAN = f"""{i.BASED}, e AS (SELECT series_id, max(day_idx) + 1 AS new FROM days GROUP BY 1),
t AS (SELECT b.* FROM based b JOIN e ON e.series_id = b.series_id WHERE day_idx >= new - 5),
m AS (SELECT t.series_id, t.day_idx, avg(p.value - p.snaive) AS mean FROM (SELECT DISTINCT series_id, day_idx FROM t) t JOIN based p ON p.series_id = t.series_id
  AND p.day_idx >= 8 AND p.day_idx < t.day_idx GROUP BY ALL)"""


@query(f"""WITH {MEAN} SELECT t.series_id, t.day_idx, t.hour, round(t.value, 9) AS actual, round(t.snaive + mean, 9) AS model FROM t JOIN m
  ON m.series_id = t.series_id AND m.day_idx = t.day_idx""")
def custom_corrector(spark: SparkSession, d: str) -> DataFrame:
    x = models.rolling_origin(i.days(spark, d), 5, corrector=MeanCorrector)
    return rounded(x.select("series_id", "day_idx", "hour", "actual", "model"), digits=9)


@query(f"""WITH {MEAN} SELECT t.series_id, t.day_idx, 'mean' AS candidate, round(avg(abs(t.snaive + mean - t.value)), 9) AS mae FROM t JOIN m
  ON m.series_id = t.series_id AND m.day_idx = t.day_idx GROUP BY 1, 2
UNION ALL SELECT series_id, day_idx, 'base', round(avg(abs(snaive - value)), 9) FROM t GROUP BY 1, 2""")
def model_shoot_out(spark: SparkSession, d: str) -> DataFrame:
    x = studies.shoot_out(i.days(spark, d), {"base": {"lams": ()}, "mean": {"corrector": MeanCorrector}}, 5)
    return rounded(x.select("series_id", "day_idx", "candidate", "mae"), digits=9)


@query(f"""WITH {i.BASED}, {BASE_FIT} SELECT 'utility ' || substr(d.series_id, 1, 1) AS utility, d.series_id, CAST(local_date + 7 AS VARCHAR) AS local_date, d.hour, round(value, 8) AS p50
FROM days d JOIN e ON e.series_id = d.series_id AND d.day_idx = new - 7""")
def tenant_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next day of every utility's series in one plan."""
    load = i.load(spark, d)
    tenants = load.select("series_id").distinct().withColumn("utility", F.concat(F.lit("utility "), F.substring("series_id", 1, 1)))
    x = service.daily_batch(load, tenants, zone="UTC", n_test=2, cal_days=7, lams=(), digits=None)["forecast"]
    return rounded(x.select("utility", "series_id", F.col("local_date").cast("string").alias("local_date"), "hour", "p50"), digits=8)
