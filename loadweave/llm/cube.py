"""Mixing sources to target weights by cube-method balanced sampling (Deville and Tille, 2004).

A source that is to take f times its words takes each document floor(f) times for certain and once
more with probability f - floor(f). The cube method settles these fractions: the undecided
documents move along the null space of the balancing constraints (number of documents, number of
words) until one is decided, at random with the right expectation, the longest first. Blocks of
documents are flown apart; what each leaves open (at most two) is gathered into larger blocks, until
a source has at most two open documents, which land on the choice nearest the word total.
"""

from __future__ import annotations

from collections.abc import Sequence
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 2_000
SEED = 20_260


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, size) -> (source, source_size, n_docs, target): sources in code-point order, null last, weigh
    1, 2, 3, 1, ...; targets share the total by weight, stop at cap times the source's size, and
    the excess is shared again by weight until none is above. One row a source; rounds are
    aggregations, only totals come to the driver."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = materialize(sums.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))))
    weighed = ranked.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double")).withColumn("most", F.col("source_size") * cap)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # each round raises the level; it ends as the set of full sources only grows
        full = F.col("most") <= F.col("weight") * level
        spent, open_weight = weighed.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        raised = (total - spent) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return weighed.select("source", "source_size", "n_docs", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def fly(p: np.ndarray, size: np.ndarray, seed: str) -> np.ndarray:
    """Flight of one block: fractions p with at most two left strictly between 0 and 1.

    Each step moves along the projection of the longest open document onto the null space of the
    constraints (1, size) over all open documents, up to the first bound, so long documents are
    decided first, while many short ones can make up for them."""
    rng, eps = Random(seed), 1e-9
    p = np.where(p <= eps, 0.0, np.where(p >= 1 - eps, 1.0, p))
    order = np.argsort(-size, kind="stable")
    open_ = order[(p[order] > 0) & (p[order] < 1)]
    while len(open_) > 2:
        s, q = size[open_].astype(float), p[open_]
        centred = s - s.mean()
        spread = float(centred @ centred)
        lever = 1 / len(s) + (centred * centred / spread if spread > 0 else 0.0)
        k = int(np.argmax(1 - lever > 1e-9))  # the longest that the constraints let move
        u = np.full(len(s), -1 / len(s))
        if spread > 0:
            u -= centred * (centred[k] / spread)
        u[k] += 1
        u[np.abs(u) < 1e-12] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            up = float(np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf))))
            down = float(np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf))))
        q = q + u * (up if rng.random() * (up + down) < down else -down)
        q = np.where(q <= eps, 0.0, np.where(q >= 1 - eps, 1.0, q))
        p[open_] = q
        open_ = open_[(q > 0) & (q < 1)]
    return p


def land(p: np.ndarray, size: np.ndarray, seed: str) -> np.ndarray:
    """The last open fractions of a source: the 0/1 choice nearest their expected words and, among
    equals, their expected number, then a seeded draw."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    want_words, want_docs = float((p[open_] * size[open_]).sum()), float(p[open_].sum())
    best = None
    for choice in range(1 << len(open_)):
        bits = [(choice >> k) & 1 for k in range(len(open_))]
        words = sum(b * float(size[i]) for b, i in zip(bits, open_))
        key = (abs(words - want_words), abs(sum(bits) - want_docs), Random(f"{seed}/{choice}").random())
        if best is None or key < best[0]:
            best = (key, bits)
    out = p.copy()
    out[open_] = best[1]
    return out


def _flight(seed: int, level: int, last: bool):
    """Flight, and at the last level landing, of one block."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tag = f"{seed}/{key}/{level}"
        pdf = pdf.sort_values(["size", "uid", "p"], ascending=False, kind="stable").drop(columns="block")
        size = pdf["size"].to_numpy()
        p = fly(pdf["p"].to_numpy(), size, tag)
        return pdf.assign(p=land(p, size, tag) if last else p)

    return run


def settle(units: DataFrame, seed: int = SEED, block: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """(group, uid, size, p) -> (group, uid, p) with every p 0 or 1, balanced in each group on the
    number of units and on size. Units of a block depend on their uid only. Columns in carry go along."""
    schema = "group string, uid long, size long, p double" + "".join(f", `{c}` {units.schema[c].dataType.simpleString()}" for c in carry)
    count = units.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    now, done, level = units.select("group", "uid", "size", "p", *carry), None, 0
    while True:
        last = count <= block
        parts = 1 if last else -(-count // (block // 2))
        keyed = now.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(seed + level)), F.lit(parts)))
        flown = materialize(keyed.groupBy("group", "block").applyInPandas(_flight(seed, level, last), schema))
        settled = flown.where("p = 0 or p = 1")
        done = settled if done is None else done.union(settled)
        if last:
            return done.select("group", "uid", "p", *carry)
        now, level = flown.where("p > 0 and p < 1"), level + 1
        count = now.groupBy("group").count().agg(F.max("count")).first()[0] or 0


def mix(docs: DataFrame, cap: float = 3.0, seed: int = SEED, block: int = BLOCK, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs(doc_id, text, source, ...): doc_id, size (words), source_size,
    target (its source's words to take), taken (words the mix takes: copies times size), copies.

    Null text has size 0. A null source is a source of its own, last in order. A source
    whose documents have no words takes nothing. Documents without words are never copied but
    stay once. Rows that repeat a doc_id, or have none, are documents of their own. Other columns
    are ignored but those in carry, which are added; an empty table gives no rows. The draw depends on seed, doc_id, source and size
    only, so reruns and other partitionings agree."""
    sized = docs.select(
        "doc_id",
        F.concat(F.lit("="), "source").alias("group"),
        "source",
        F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long").alias("size"),
        F.xxhash64("text").alias("mark"),
        *carry,
    )
    # rows that repeat an id are numbered, by text, so that uid tells them apart
    again = W.partitionBy("doc_id", "source", "size").orderBy("mark")
    sized = materialize(sized.withColumn("group", F.coalesce("group", F.lit("-"))))
    sized = sized.withColumn("copy", F.row_number().over(again))
    sized = sized.withColumn("uid", F.xxhash64("doc_id", "group", "size", "copy"))
    # uid spreads and orders the draw; the row itself is known by this exact key and its group, as hashes may meet
    exact = F.concat_ws("/", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")), "size", "copy")
    sized = sized.withColumn("exact", exact)
    targets = source_targets(sized.select("source", "size"), cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = materialize(
        sized.join(targets, sized.source.eqNullSafe(targets.source))
        .select("doc_id", "group", "uid", "exact", "size", "source_size", "target", rate.alias("rate"), *carry)
        .withColumn("whole", F.floor(F.col("rate") + 1e-12))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    )
    drawn = settle(known.where("size > 0 and p > 0"), seed, block, ["exact"])
    joined = known.join(drawn.select("group", "uid", "exact", F.col("p").alias("extra")), ["group", "uid", "exact"], "left")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("whole") + F.coalesce("extra", F.lit(0.0))).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "uid", *carry)


def take(docs: DataFrame, cap: float = 3.0, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """docs, all columns, each row as many times as mix() takes it, rows that repeat a doc_id or have
    none too. Rows are written once with a key, by which they meet their numbers of copies. Null texts, empty ones and
    ones without words stay once each, also those of a source without any word; no rows, no result."""
    row, copies, copy = (fresh(docs, c) for c in ("row_key", "row_copies", "row_copy"))
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    drawn = mix(rows, cap, seed, block, [row]).where("copies > 0").select(row, F.col("copies").cast("int").alias(copies))
    return rows.join(drawn, row).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(docs.columns)
