"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(src, dst) long -> (id, component): every node that is not the smallest of its
    component, with that smallest node. Null ends and loops are ignored; no edges, no rows.

    Each round is two aggregations by key and two joins that adaptive execution may split, so a
    hub with a large share of all edges is no single task. Lineage is cut after each round, and the
    round before it deleted."""
    now = materialize(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct()
    )
    seen = _signature(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(low, "a")
        old, now = now, materialize(
            near.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .where("a != b")
            .distinct()
        )
        discard(old)
        before, seen = seen, _signature(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
