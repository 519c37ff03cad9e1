"""Helpers that the corpus operators share: tables, scratch space, streaming over key groups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Only where a local session names none (as in tests) a temporary
    folder is set, and removed at exit; a cluster's executors couldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loadweave-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared scratch folder and read it again.
    The files outlive any executor; they go with the folder, or by discard(). options: more of the writer."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialize() result that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def key_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 65536) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches that are sorted by key: groups that end in one
    batch come together, the last one waits for the next batch."""
    held: list[pa.RecordBatch] = []
    held_rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        held_rows += batch.num_rows
        if held_rows < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield whole.slice(0, cut)
        rest = whole.slice(cut)
        held = rest.to_batches()
        held_rows = rest.num_rows
        rows = max(rows, 2 * held_rows) if not cut else rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_key(df: DataFrame, key: str, function: Callable, schema: str) -> DataFrame:
    """Run function(table of whole groups) -> iterator of record batches over df, each key's rows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in key_runs(batches, key):
            yield from function(part)

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def splits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.r_[starts[1:], len(keys)].astype(np.int64)
