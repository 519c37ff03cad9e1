"""Tamper-evident records and the stores and reports built on them."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "0" * 64  # fixed value: what the first entry of a ledger follows
ENTRY = "ledger_id string, seq long, prev_hash string, payload string, entry_hash string"


def payload_json(*columns: Column | str) -> Column:
    """The fixed format of a payload: JSON of the named columns in name order, no blanks; nested structs must be ordered by the caller."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _linked(entries: DataFrame) -> DataFrame:
    """(ledger_id, seq, payload, head, start) -> linked entries, numbered from start where it is given. Rows come sorted by ledger
    and seq; the hash so far is all that is held, so a task takes many short ledgers, or one of any length, in a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = batches  # no ledger's name
        prev, k = "", 0
        for b in batches:
            before, after, seqs = [], [], []
            for ledger_id, seq, payload, head, start in zip(*(b.column(c).to_pylist() for c in ("ledger_id", "seq", "payload", "head", "start"))):
                if ledger_id != now:
                    now, prev, k = ledger_id, head, 0
                before.append(prev)
                prev = hashlib.sha256((prev + payload).encode()).hexdigest()
                after.append(prev)
                seqs.append(seq if start is None else start + k)
                k += 1
            columns = [b.column("ledger_id"), pa.array(seqs, pa.int64()), pa.array(before, pa.string()), b.column("payload"), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["ledger_id", "seq", "prev_hash", "payload", "entry_hash"])

    x = entries.select(F.col("ledger_id").cast("string"), F.col("seq").cast("long"), "payload", "head", "start")
    return x.repartition("ledger_id").sortWithinPartitions("ledger_id", "seq").mapInArrow(run, ENTRY)


def chain(entries: DataFrame, head: str = GENESIS) -> DataFrame:
    """(ledger_id, seq, payload) -> hash chain per ledger: entry_hash = sha256(prev_hash + payload). Sequential
    by nature inside a ledger; ledgers run in parallel, many in a task."""
    return _linked(entries.select("ledger_id", "seq", "payload", F.lit(head).alias("head"), F.lit(None).cast("long").alias("start")))


def verify(ledger: DataFrame, head: str = GENESIS) -> DataFrame:
    """(ledger_id, n_entries, first_broken, chain_ok): first_broken is the position of the first entry whose
    link or hash is wrong, null if there is none. Windows and hashes only."""
    order = W.partitionBy("ledger_id").orderBy("seq")
    bad = (F.col("prev_hash") != F.coalesce(F.lag("entry_hash").over(order), F.lit(head))) | (F.sha2(F.concat("prev_hash", "payload"), 256) != F.col("entry_hash"))
    x = ledger.withColumn("pos", F.row_number().over(order) - 1).withColumn("bad", bad)
    x = x.groupBy("ledger_id").agg(F.count("*").alias("n_entries"), F.min(F.when(F.col("bad"), F.col("pos"))).cast("long").alias("first_broken"))
    return x.withColumn("chain_ok", F.col("first_broken").isNull())


def append(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Entries to add after the stored ones; refuses if any stored chain is broken."""
    if not verify(ledger).where(~F.col("chain_ok")).isEmpty():
        raise ValueError("a stored chain is broken; nothing is appended")
    heads = ledger.groupBy("ledger_id").agg(F.max_by("entry_hash", "seq").alias("h"), F.max("seq").alias("s"))
    x = new.select("ledger_id", "seq", "payload").join(heads, "ledger_id", "left")
    return _linked(x.select("ledger_id", "seq", "payload", F.coalesce("h", F.lit(GENESIS)).alias("head"), F.coalesce(F.col("s") + 1, F.lit(0)).alias("start")))


def seal(head_hash: str, key: bytes) -> str:
    """HMAC-SHA256 of a chain's head."""
    return hmac.new(key, head_hash.encode(), hashlib.sha256).hexdigest()


# --- reports ------------------------------------------------------------------------------------
def monthly_report(events: DataFrame, month: str) -> DataFrame:
    """(ts, decision_type, magnitude_kw, duration_min, affected array<struct<device_id, shed_kw>>) of a month yyyy-MM:
    per type the count, distinct devices that shed (all named if none says how much), mean
    magnitude and total minutes."""
    x = events.where(F.date_format("ts", "yyyy-MM") == month).withColumn("row", F.monotonically_increasing_id())
    base = x.groupBy("decision_type").agg(F.count("*").alias("n"), F.avg("magnitude_kw").alias("mean_kw"), F.sum("duration_min").alias("minutes"))
    dev = x.select("decision_type", F.explode_outer("affected").alias("a"))
    shed = F.col("a.shed_kw")
    dev = dev.groupBy("decision_type").agg(
        F.count_distinct(F.when(shed > 1e-9, F.col("a.device_id"))).alias("shedding"), F.count_distinct("a.device_id").alias("named"), F.count(shed).alias("known")
    )
    devices = F.when(F.col("known") > 0, F.col("shedding")).otherwise(F.col("named"))
    return base.join(dev.select("decision_type", devices.alias("devices")), "decision_type")


def fairness(events: DataFrame) -> DataFrame:
    """(device_id, shed_kw, demand_kw): per device total shed and mean shed share; relative is false if a demand
    is missing anywhere, and then the absolute total is the burden."""
    x = events.withColumn("share", F.when(F.col("demand_kw") > 0, F.col("shed_kw") / F.col("demand_kw")))
    x = x.groupBy("device_id").agg(F.sum("shed_kw").alias("shed_kwh"), F.avg("share").alias("share"), F.bool_and(F.col("demand_kw") > 0).alias("known"))
    x = x.crossJoin(x.agg(F.coalesce(F.bool_and(F.coalesce("known", F.lit(False))), F.lit(False)).alias("relative")))  # one row
    return x.withColumn("burden", F.when(F.col("relative"), F.col("share")).otherwise(F.col("shed_kwh"))).drop("known")


def interventions(hourly: DataFrame, decision: str, amount: str, asset: str, **fixed: str) -> DataFrame:
    """Hours of a plan with an amount above nothing, as event rows for the ledger."""
    x = hourly.where(F.col(amount) > 1e-9).select(
        F.col(asset).alias("asset_id"), "hour", F.lit(decision).alias("decision_type"), F.col(amount).alias("magnitude_kw"), F.lit(60).alias("duration_min")
    )
    return x.withColumns({k: F.lit(v) for k, v in fixed.items()})


# --- stores -------------------------------------------------------------------------------------
def save_forecasts(forecasts: DataFrame, path: str) -> None:
    """(utility, forecast_date, stored_utc, ...): one partition per utility and date, overwritten on its own."""
    forecasts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("utility", "forecast_date").parquet(path)


def latest_saved(forecasts: DataFrame, keys: Sequence[str] = ("utility",)) -> DataFrame:
    """The date that was saved last, which need not be the newest date."""
    return forecasts.groupBy(*keys).agg(F.max_by("forecast_date", F.struct("stored_utc", "forecast_date")).alias("forecast_date"), F.max("stored_utc").alias("stored_utc"))


def save_prior(prior: DataFrame, path: str) -> None:
    """A pool prior (weights, and whatever describes it), replaced as a whole."""
    prior.coalesce(1).write.mode("overwrite").parquet(path)  # one row


def load_prior(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored prior, or None where there is none: then models go without."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def append_issued(issued: DataFrame, path: str) -> None:
    """Issued forecasts are only ever added, with the time of issue."""
    issued.write.mode("append").partitionBy("series_id").parquet(path)


def track_record(issued: DataFrame, actuals: DataFrame) -> DataFrame:
    """issued(series_id, target_date, issued_utc, p10, p50, p90 arrays) against actuals(series_id, target_date, actual
    array): the last issue of a date counts, dates without actuals or of another length are passed
    over. MAE, bias, coverage percent per date."""
    last = issued.withColumn("k", F.row_number().over(W.partitionBy("series_id", "target_date").orderBy(F.desc("issued_utc")))).where("k = 1")
    x = last.join(actuals, ["series_id", "target_date"]).where("size(p50) = size(actual)")
    x = x.select("series_id", "target_date", F.posexplode(F.arrays_zip("p10", "p50", "p90", "actual")).alias("hour", "v")).select("series_id", "target_date", "hour", "v.*")
    e = F.col("actual") - F.col("p50")
    return x.groupBy("series_id", "target_date").agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), (100 * F.avg(F.col("actual").between(F.col("p10"), F.col("p90")).cast("double"))).alias("coverage")
    )


def last_residuals(issued: DataFrame, actuals: DataFrame) -> DataFrame:
    """(series_id, hour, residual): actual minus issued median on each series' last date that has actuals, as last issued."""
    last = issued.groupBy("series_id", "target_date").agg(F.max_by("p50", "issued_utc").alias("p50"))
    x = last.join(actuals, ["series_id", "target_date"]).where("size(p50) = size(actual)")
    x = x.groupBy("series_id").agg(F.max_by(F.arrays_zip("p50", "actual"), "target_date").alias("v"))
    return x.select("series_id", F.posexplode("v").alias("hour", "v")).select("series_id", "hour", (F.col("v.actual") - F.col("v.p50")).alias("residual"))


def last_days(record: DataFrame, n: int = 30) -> DataFrame:
    k = F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("target_date")))
    return record.withColumn("k", k).where(F.col("k") <= n).drop("k")


def keep_reference(store: DataFrame | None, new: DataFrame, keys: Sequence[str] = ("utility",)) -> DataFrame:
    """Drift references that aren't stored yet: an existing one is never replaced."""
    return new if store is None else new.join(store.select(*keys), list(keys), "left_anti")


def catalogue(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """A temporary view per Parquet table, for spark.sql."""
    for name, path in paths.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    return sorted(paths)
