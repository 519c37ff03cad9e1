"""Price files: imbalance and spot prices in several encodings and layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite, localize

ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")
# Value columns by priority.
VALUE_COLUMNS = ["reBAP_EUR_MWh", "reBAP unterdeckt", "reBAP", "spot_DA_EUR_MWh", "Preis", "price"]


def decimal(text) -> object:
    """German decimals only where a comma is present."""
    t = F.trim(text)
    german = F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")
    return finite(F.when(t.contains(","), german).otherwise(t).try_cast("double"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The file under its header, all text, with pos; the first encoding that leaves no replacement
    character, the separator that the header has most."""
    for encoding in ENCODINGS:
        lines = spark.read.option("encoding", encoding).text(path)
        head = [r["value"] for r in lines.limit(40).collect()]
        if not any("�" in x for x in head):
            break
    header = next((x for x in head if any(c.lower() in x.lower() for c in VALUE_COLUMNS)), head[0] if head else "")
    sep = max(";,\t", key=header.count)
    names = [c.strip().strip('"') for c in header.split(sep)]
    rows = lines.withColumn("pos", F.monotonically_increasing_id()).where((F.col("value") != header) & (F.trim("value") != ""))
    cells = F.split("value", f"[{sep}]", -1)
    out = rows.select("pos", *(F.trim(F.get(cells, F.lit(i))).alias(n) for i, n in enumerate(names)))
    return out.withColumn("pos", F.row_number().over(W.orderBy("pos")) - 1)  # a position in one file is inherently one order


def value_column(df: DataFrame) -> str:
    for name in VALUE_COLUMNS:
        for c in df.columns:
            if c.lower().startswith(name.lower()):
                return c
    raise ValueError(f"no price column among {df.columns}")


def read_prices(spark: SparkSession, path: str, keep_gaps: bool = False) -> DataFrame:
    """(pos, ts, price): ts from Zeit (ISO with offset) where there is one. Gaps stay only if positions matter."""
    df = read_cells(spark, path)
    price = decimal(F.col(f"`{value_column(df)}`"))
    ts = F.try_to_timestamp("Zeit") if "Zeit" in df.columns else F.lit(None).cast("timestamp")
    out = df.select("pos", ts.alias("ts"), price.alias("price"))
    return out if keep_gaps else out.where("price is not null")


def normalise_official(df: DataFrame, under: str, over: str, keep: Sequence[str] = ()) -> DataFrame:
    """Datum, von, Zeitzone (CET or CEST) and two price columns -> (ts UTC, under, over), beside the columns in keep."""
    local = F.try_to_timestamp(F.concat_ws(" ", "Datum", "von"), F.lit("dd.MM.yyyy HH:mm"))
    utc = local - F.make_dt_interval(hours=F.when(F.col("Zeitzone") == "CEST", 2).otherwise(1))
    return df.select(*keep, utc.alias("ts"), decimal(F.col(f"`{under}`")).alias("under"), decimal(F.col(f"`{over}`")).alias("over"))


def asymmetry(official: DataFrame) -> DataFrame:
    """Rows, rows whose two prices differ, and the largest difference."""
    d = F.abs(F.col("under") - F.col("over"))
    return official.agg(F.count("*").alias("n"), F.count_if(d > 1e-9).alias("n_asymmetric"), F.max(d).alias("max_difference"))


def first_per_time(prices: DataFrame) -> DataFrame:
    return prices.withColumn("k", F.row_number().over(W.partitionBy("ts").orderBy("pos"))).where("k = 1").drop("k")


def local_prices(df: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """Naive local times to UTC, the second of a repeated hour as standard time."""
    again = F.row_number().over(W.partitionBy("local").orderBy("pos")) > 1
    return df.withColumn("ts", localize("local", again, zone))
