"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bayes, bpe, chat, covertree, cube, importance, lattice, quality, runs, simhash, sketch, suffix
from .common import table


def op1_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix(table(spark, sf_dir, "documents")).drop("uid")


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lengths = bpe.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.length_histogram(lengths)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


def op7_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bayes.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("mask", chat.mask_text())


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return importance.draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


def op12_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.likeness_to_edits(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(table(spark, sf_dir, "documents"), edit=runs.repeat_tail))


QUERIES = {
    "op1_cover_tree_links": op1_cover_tree_links,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_source_mix": op3_source_mix,
    "op4_lattice_score": op4_lattice_score,
    "op5_token_histogram": op5_token_histogram,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_ngram_quality": op7_ngram_quality,
    "op8_site_bayes": op8_site_bayes,
    "op9_simhash_components": op9_simhash_components,
    "op10_perspective_rotation": op10_perspective_rotation,
    "op11_importance_draw": op11_importance_draw,
    "op12_bottom_k": op12_bottom_k,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op10_perspective_rotation": chat.SQL,
    "op11_importance_draw": importance.SQL,
    "op13_periodic_runs": runs.SQL,
}
