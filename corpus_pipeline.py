"""The corpus pipeline: five stages over documents, each calling one operator of loadweave.llm.

Every stage but the last returns the columns of documents. Each stage's result is written and read
again by the next, so a lost executor costs at most the stage it ran; run() deletes a stage's result once the next
one is written.

All stages: other columns stay as they are, whatever their names; no rows, no result; equal rows are rows of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loadweave.llm import bayes, bpe, cube, quality, simhash, suffix
from loadweave.llm.common import discard, materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier doesn't reject. Null and empty texts are judged by their site alone. A doc_id goes
    if any of its rows is rejected; rows without an id stay."""
    return bayes.drop_rejected(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component; rows without an id stay. Null, empty and blank texts have
    fingerprint zero and are near one another. Of rows that repeat the smallest id, the one with the first text stays."""
    return simhash.drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier; n_chars follows. A cut inside a character
    drops what is left of it. Documents stay even where nothing of their text does."""
    return suffix.cut_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the balanced mix takes it. A null source is one more source; rows without words stay once;
    rows that repeat an id or have none are drawn each for themselves."""
    return cube.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each copy taken, one row a row; a null text is empty."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("source mix", source_mix),
    ("byte-level bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
