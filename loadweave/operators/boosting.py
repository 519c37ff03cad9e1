"""Quantile models by gradient-boosted trees on binned features, for all series and levels at once.

A round grows one tree for each series and level: on each of its depths the rows of each node are counted by feature and bin, the
best split of every node follows from these counts, and rows move to its sides. A leaf's value is the quantile of what is left
of its rows. Counts are aggregates that are combined before they are shuffled, and as small as nodes x features x bins, so a
series of any length takes the same shuffle; rows move by joins with one row a node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relations import _cut

KEY = ["series_id", "day_idx", "hour"]


def binned(rows: DataFrame, bins: int) -> DataFrame:
    """rows with bins: for each feature the number of the series' (approximate) quantiles of training rows below it."""
    levels = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    each = rows.where("train").select("series_id", F.posexplode("x").alias("f", "v"))
    edges = each.groupBy("series_id", "f").agg(F.percentile_approx("v", levels).alias("e"))
    edges = edges.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("s")).select("series_id", F.col("s.e").alias("edges"))
    place = F.transform("x", lambda v, i: F.size(F.filter(F.array_distinct(F.get("edges", i)), lambda e: e < v)))
    return rows.join(edges, "series_id").withColumn("bins", place).drop("edges", "x")


def _split(state: DataFrame, aims: Column, least: int) -> DataFrame:
    """(series_id, level, node, f, b): the split feature <= b of each node whose gradients differ most between its sides, each of at
    least `least` rows; the first feature and bin on ties. A gradient is the level less 1 for rows below their prediction, so
    sums of them come from two counts, exactly."""
    t = state.where("train").select("series_id", "level", "node", (F.col("target") < F.col("pred")).alias("under"), F.posexplode("bins").alias("f", "b"))
    counts = t.groupBy("series_id", "level", "node", "f", "b").agg(F.count("*").alias("n"), F.count_if("under").alias("u"))
    feature = W.partitionBy("series_id", "level", "node", "f")
    upto = feature.orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    s = counts.withColumns({"nl": F.sum("n").over(upto), "ul": F.sum("u").over(upto), "na": F.sum("n").over(feature), "ua": F.sum("u").over(feature)})
    part = lambda n, u: F.pow(aims * n - u, F.lit(2.0)) / n
    nr, ur = F.col("na") - F.col("nl"), F.col("ua") - F.col("ul")
    s = s.where((F.col("nl") >= least) & (nr >= least)).withColumn("gain", F.round(part(F.col("nl"), F.col("ul")) + part(nr, ur) - part(F.col("na"), F.col("ua")), 9))
    best = F.max_by(F.struct("f", "b"), F.struct("gain", -F.col("f"), -F.col("b"))).alias("s")
    return s.where("gain > 0").groupBy("series_id", "level", "node").agg(best).select("series_id", "level", "node", "s.f", "s.b")


def boosted_quantiles(
    rows: DataFrame, levels: Sequence[float] = (0.1, 0.5, 0.9), train_until: int | None = None, rounds: int = 12, depth: int = 2, rate: float = 0.2,
    bins: int = 16, least: int = 30, target: str = "value", also: Sequence[str] = ("base", "hour")
) -> DataFrame:
    """rows(series_id, day_idx, hour, x, value, base, ...), a row an hour, -> rows with the levels' forecasts of the target, crossing
    ones sorted, as p10, p50, ...: trees on x and the columns in `also`, fitted on the days before train_until (all rows with a
    target, if None).

    The value itself is fitted, with the base as a feature: a tree can then trust a noisy base as far as it deserves, which one
    fitted on the differences from it can't. Rows without a target are only predicted. Series without training rows go. A
    table is written once a round."""
    aims = F.get(F.array(*(F.lit(float(v)) for v in levels)), F.col("level"))
    y = F.col(target).cast("double")
    train = y.isNotNull() & ~F.isnan(y)
    train = train if train_until is None else train & (F.col("day_idx") < train_until)
    wide = F.concat("x", F.array(*(F.col(c).cast("double") for c in also))) if also else F.col("x")
    x = binned(rows.select(*KEY, wide.alias("x"), y.alias("target"), train.alias("train")), bins)
    quantile = lambda c: F.percentile(c, F.array(*(F.lit(float(v)) for v in levels)))
    start = x.where("train").groupBy("series_id").agg(quantile("target").alias("start"))
    state = x.join(start, "series_id").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))))
    state = _cut(state.withColumn("pred", F.get("start", F.col("level"))).drop("start"))
    for _ in range(rounds):
        now = state.withColumn("node", F.lit(1))
        for _ in range(depth):
            split = _split(now, aims, least)
            right = F.coalesce(F.get("bins", F.col("f")) > F.col("b"), F.lit(False)).cast("int")
            now = now.join(split, ["series_id", "level", "node"], "left").withColumn("node", 2 * F.col("node") + right).drop("f", "b")
        left = F.col("target") - F.col("pred")
        leaves = now.where("train").groupBy("series_id", "level", "node").agg(quantile(left).alias("q")).select("series_id", "level", "node", F.get("q", F.col("level")).alias("step"))
        now = now.join(leaves, ["series_id", "level", "node"], "left")
        state = _cut(now.withColumn("pred", F.col("pred") + rate * F.coalesce("step", F.lit(0.0))).drop("node", "step"))
    found = state.groupBy(*KEY).agg(F.array_sort(F.collect_list("pred")).alias("q"))
    return rows.join(found, KEY).select(*rows.columns, *(F.col("q")[i].alias(f"p{round(100 * v):02d}") for i, v in enumerate(levels)))
