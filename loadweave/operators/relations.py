"""Joins, set operations and de-duplication of series and catalogues."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import easter


def dealt_union(keys: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Frames below each other by column name (missing columns null), dealt by the keys anew. Windows, groups and joins by
    these keys then need no further shuffle, and never rest on partitionings that the frames happen to have:
    Spark 4.1 takes those over for the union, drops a repartition that says the same, and adaptive execution may then change one
    of them alone. So the first frame's keys are taken through an array, which has no partitioning to take over."""
    out = frames[0]
    if len(frames) > 1:
        out = out.withColumns({c: F.element_at(F.array(c), 1) for c in keys})
    for x in frames[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.repartition(*keys)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order: deterministic, unlike dropDuplicates."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def price_pairs(rebap: DataFrame, spot: DataFrame) -> DataFrame:
    """(ts, price) of both inner-joined by time and averaged by hour: (ts, rebap, spot)."""
    a, b = rebap.select("ts", F.col("price").alias("rebap")), spot.select("ts", F.col("price").alias("spot"))
    x = a.join(b, "ts").na.drop().groupBy(F.date_trunc("hour", "ts").alias("ts"))
    return x.agg(F.avg("rebap").alias("rebap"), F.avg("spot").alias("spot"))


def positional_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pos, price) of both joined by row position, non-finite pairs dropped; unequal lengths are an error."""
    n = [x.count() for x in (left, right)]
    if n[0] != n[1]:
        raise ValueError(f"{n[0]} and {n[1]} rows can't be paired by position")
    return left.select("pos", F.col("price").alias("rebap")).join(right.select("pos", F.col("price").alias("spot")), "pos").na.drop().where("not isnan(rebap) and not isnan(spot)")


def hours_of_prices(quarters: DataFrame, hourly: DataFrame) -> DataFrame:
    """Hourly prices on a quarter-hour axis by the hour's floor; hits and misses by count of `price`."""
    p = hourly.select(F.date_trunc("hour", "ts").alias("hour_ts"), "price")
    return quarters.withColumn("hour_ts", F.date_trunc("hour", "ts")).join(p, "hour_ts", "left").drop("hour_ts")


def common_times(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("ts",)) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi")


def series_hash(series: DataFrame) -> DataFrame:
    """(series_id, content_hash): SHA-256 over the time-ordered values, rounded to 6 digits."""
    item = F.concat_ws(":", F.unix_timestamp("ts"), F.format_string("%.6f", F.round("value", 6)))
    by = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ts", item.alias("item")))).alias("items"))
    return by.select("series_id", F.sha2(F.array_join(F.transform("items", lambda x: x["item"]), ","), 256).alias("content_hash"))


def exact_duplicates(hashed: DataFrame) -> DataFrame:
    """Adds canonical: the first series with the same content."""
    return hashed.withColumn("canonical", F.min("series_id").over(W.partitionBy("content_hash")))


def _correlation() -> list[Column]:
    """overlap, r and both deviations of va and vb; r is null where one is constant (corr() would be an error there)."""
    sa, sb = F.stddev_pop("va"), F.stddev_pop("vb")
    return [F.count("*").alias("overlap"), F.try_divide(F.covar_pop("va", "vb"), sa * sb).alias("r"), sa.alias("sa"), sb.alias("sb")]


def pair_correlations(series: DataFrame, least_overlap: int = 7200) -> DataFrame:
    """(a, b, overlap, r) of all series pairs a < b that share enough times: an equi-join by time, so
    pairs without a common time cost nothing, then one aggregation."""
    x = series.where("value is not null")
    a, b = (x.select("ts", F.col("series_id").alias(n), F.col("value").alias(f"v{n}")) for n in ("a", "b"))
    pairs = a.join(b, "ts").where("a < b").groupBy("a", "b")
    r = pairs.agg(*_correlation())
    return r.where((F.col("overlap") >= least_overlap) & (F.col("sa") > 0) & (F.col("sb") > 0)).select("a", "b", "overlap", "r")


def _waves(n: Column) -> Column:
    """Six distinct frequencies below half of n, so that their waves are orthonormal: those of hourly values' day, half day and week
    and the slowest ones, or where n is too short for these the six slowest; null for the shortest."""
    usual = F.array(F.round(n / 24), F.round(n / 12), F.round(n / 168), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    sound = (F.size(F.array_distinct(usual)) == 6) & (F.array_min(usual) >= 1) & (F.array_max(usual) * 2 < n)
    return F.when(sound, usual).when(n > 12, F.array(*(F.lit(float(k)) for k in range(1, 7))))


def _coefficients(series: DataFrame, sets: DataFrame) -> DataFrame:
    """(series_id, support, c: coefficients of the centred series of length 1 in an orthonormal wave basis, null where there is none)."""
    x = series.join(sets.withColumn("waves", _waves(F.col("n"))), "series_id").where("norm > 0")
    x = x.withColumn("j", F.row_number().over(W.partitionBy("series_id").orderBy("ts")) - 1).withColumn("z", (F.col("value") - F.col("mean")) / F.col("norm"))
    sums = []
    for k in range(6):
        angle = 2 * math.pi * F.get("waves", F.lit(k)) * F.col("j") / F.col("n")
        sums += [F.sum(F.col("z") * f(angle)) * F.sqrt(2 / F.first("n")) for f in (F.cos, F.sin)]
    return x.groupBy("series_id").agg(F.first("support").alias("support"), F.when(F.first("waves").isNotNull(), F.array(*sums)).alias("c"))


def correlation_candidates(series: DataFrame, threshold: float, least_overlap: int = 7200, dims: int = 3) -> DataFrame:
    """(a, b), a < b: pairs whose correlation can reach the threshold, no other of them missing.

    Series with the same times, centred and of length 1, are at a squared distance of 2 (1 - r). In an orthonormal basis the
    distance of some coefficients is at most the whole one, so series that correlate enough lie in cells of that width of the first
    `dims` coefficients that are the same or neighbours, and near in all coefficients. Pairs with different times, or in too short
    a support for the basis, are candidates if they share enough times."""
    x = series.where("value is not null").select("series_id", "ts", "value")
    stats = x.groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.concat_ws("/", F.count("*"), F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.sum(F.xxhash64("ts") % 1_000_000_007), F.bit_xor(F.xxhash64("ts"))).alias("support"),
    )
    sets = stats.withColumn("norm", F.col("sd") * F.sqrt("n"))
    c = _cut(_coefficients(x, sets))
    eps = math.sqrt(max(0.0, 2 * (1 - threshold))) * (1 + 1e-9) + 1e-9
    cell = F.array(*(F.floor(F.col("c")[k] / eps) for k in range(dims)))
    good = c.where("c is not null").withColumn("cell", cell)
    steps = F.array(*(F.array(*(F.lit(int(v)) for v in v3)) for v3 in product((-1, 0, 1), repeat=dims)))
    near = good.select(F.col("series_id").alias("a"), "support", F.col("c").alias("ca"), F.explode(F.transform(steps, lambda s: F.zip_with("cell", s, lambda p, q: p + q))).alias("cell"))
    far2 = F.aggregate(F.zip_with("ca", "cb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    same = near.join(good.select(F.col("series_id").alias("b"), "support", F.col("c").alias("cb"), "cell"), ["support", "cell"]).where("a < b").where(far2 <= eps * eps).select("a", "b")
    # the others: pairs of different times share some of them, or they are none
    kinds = sets.where("norm > 0").join(c, ["series_id", "support"], "left").select("series_id", F.when(F.col("c").isNotNull(), F.col("support")).alias("grid"))
    timed = x.join(kinds, "series_id")
    if kinds.agg(F.count_distinct("grid") + F.max(F.col("grid").isNull().cast("int"))).first()[0] in (None, 1) and kinds.where("grid is null").isEmpty():
        return same
    a, b = (timed.select("ts", F.col("series_id").alias(k), F.col("grid").alias(f"grid_{k}")) for k in ("a", "b"))
    mixed = a.join(b, "ts").where("a < b and not coalesce(grid_a = grid_b, false)").groupBy("a", "b").count().where(F.col("count") >= least_overlap).select("a", "b")
    return dealt_union(["a", "b"], same, mixed)


def correlated_pairs(series: DataFrame, threshold: float, least_overlap: int = 7200, dims: int = 3) -> DataFrame:
    """(a, b, overlap, r) of the pairs with r >= threshold: pair_correlations() without comparing all pairs. Only the candidates'
    values meet, by time."""
    x = series.where("value is not null").select("series_id", "ts", "value")
    found = _cut(correlation_candidates(series, threshold, least_overlap, dims))
    left = found.join(x.select(F.col("series_id").alias("a"), "ts", F.col("value").alias("va")), "a")
    pairs = left.join(x.select(F.col("series_id").alias("b"), "ts", F.col("value").alias("vb")), ["b", "ts"]).groupBy("a", "b")
    r = pairs.agg(*_correlation())
    return r.where((F.col("overlap") >= least_overlap) & (F.col("sa") > 0) & (F.col("sb") > 0) & (F.col("r") >= threshold)).select("a", "b", "overlap", "r")


def clusters(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id) and edges (a, b) -> (id, component): smallest id reachable, by min-label rounds with
    pointer jumping; lineage is cut each round at spark.checkpoint.dir."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    now = nodes.select("id", F.col("id").alias("component")).distinct()
    for _ in range(rounds):
        near = both.join(now, both.v == now.id).groupBy("u").agg(F.min("component").alias("m"))
        hop = now.join(near, now.id == near.u, "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("next"))
        jump = now.select(F.col("id").alias("j"), F.col("component").alias("over"))
        new = hop.join(jump, hop.next == jump.j, "left").select("id", "component", F.least("next", F.coalesce("over", "next")).alias("new"))
        new = _cut(new)
        moved = new.where("new <> component").limit(1).count()
        now = new.select("id", F.col("new").alias("component"))
        if not moved:
            return now
    raise RuntimeError("clusters did not settle")


def _scratch(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may do without, and gets one that goes at exit: a
    folder of its own machine is no good to a cluster's executors."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="loadweave-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared scratch folder and read again: what it took to make it is done once and is not
    planned again (a checkpoint would keep its constraints, which the optimizer multiplies)."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def representatives(entries: DataFrame, components: DataFrame) -> DataFrame:
    """(id, n_hours, mean_load) -> per component the member with most hours, then load, then id."""
    best = F.max_by("id", F.struct("n_hours", "mean_load", "id")).alias("representative")
    return entries.join(components, "id").groupBy("component").agg(best, F.count("*").alias("members"))


def holidays(years: DataFrame, region: str | None = None) -> DataFrame:
    """(year) -> (holiday, name) of Germany, computed; region adds the days of a state code."""
    e = easter("year")
    fixed = {"Neujahr": (1, 1), "Tag der Arbeit": (5, 1), "Tag der Deutschen Einheit": (10, 3), "1. Weihnachtstag": (12, 25), "2. Weihnachtstag": (12, 26)}
    moving = {"Karfreitag": -2, "Ostermontag": 1, "Christi Himmelfahrt": 39, "Pfingstmontag": 50}
    if region in {"BW", "BY", "ST"}:
        fixed["Heilige Drei Koenige"] = (1, 6)
    if region in {"BW", "BY", "HE", "NW", "RP", "SL"}:
        moving["Fronleichnam"] = 60
    if region in {"BW", "BY", "NW", "RP", "SL"}:
        fixed["Allerheiligen"] = (11, 1)
    if region in {"BB", "HB", "HH", "MV", "NI", "SN", "ST", "SH", "TH"}:
        fixed["Reformationstag"] = (10, 31)
    days = [F.struct(F.make_date("year", F.lit(m), F.lit(d)).alias("holiday"), F.lit(n).alias("name")) for n, (m, d) in fixed.items()]
    days += [F.struct(F.date_add(e, k).alias("holiday"), F.lit(n).alias("name")) for n, k in moving.items()]
    return years.select(F.explode(F.array(*days)).alias("h")).select("h.*")


def override_holidays(base: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """(base and add) without remove: removal wins."""
    return dealt_union(["holiday"], base.select("holiday"), add.select("holiday")).distinct().join(remove.select("holiday"), "holiday", "left_anti")


def round_robin(items: DataFrame, group: str, item: str, limit: int, per_group: int | None = None) -> DataFrame:
    """First items of all groups, then second ones, ... up to limit."""
    x = items.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(item)))
    x = x if per_group is None else x.where(F.col("turn") <= per_group)
    return x.orderBy("turn", group).limit(limit)


def still_to_do(manifest: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries without a result: what a resumed run does."""
    return manifest.join(results.select(*keys).distinct(), list(keys), "left_anti")
