"""Hierarchical reconciliation (MinT): the nearest coherent forecasts under a weighting of nodes.

Nested trees (tree_id, node_id, parent_id) of any size are solved in two passes of aggregations and joins, one step a
level: sums and their variances up, corrections down (`reconcile_tree`). A general hierarchy (node_id, leaf_id, weight), where
nodes may overlap or weigh their leaves, is for small ones: its projection is one dense solve in Python, applied to each
period in column expressions (`reconcile`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relations import _cut, dealt_union


def projection(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """S (S' W^-1 S)^-1 S' W^-1."""
    inverse = np.linalg.inv(weights)
    return s @ np.linalg.solve(s.T @ inverse @ s, s.T @ inverse)


def node_weights(s: np.ndarray, method: str, residuals: np.ndarray | None = None, shrink: float = 0.2) -> np.ndarray:
    """Error covariance of the nodes: ols identity, wls_struct leaf counts, wls_var residual variances,
    mint_shrink their covariance shrunk toward its diagonal."""
    if method == "ols":
        return np.eye(len(s))
    if method == "wls_struct":
        return np.diag(s.sum(1))
    if residuals is None or len(residuals) < 2:
        raise ValueError(f"{method} needs residuals")
    cov = np.atleast_2d(np.cov(residuals, rowvar=False, ddof=1))
    var = np.maximum(np.diag(cov), 1e-9)
    if method == "wls_var":
        return np.diag(var)
    if method == "mint_shrink":
        return shrink * np.diag(var) + (1 - shrink) * cov + 1e-9 * np.eye(len(s))
    raise ValueError(method)


def projections(hierarchy: DataFrame, method: str = "ols", residuals: DataFrame | None = None, shrink: float = 0.2) -> DataFrame:
    """(tree_id, nodes, rows): the nodes of a tree in order and, for each, its row of the projection. One small dense
    solve a tree, whatever the number of periods."""
    h = hierarchy.groupBy("tree_id").agg(F.collect_list(F.struct("node_id", "leaf_id", "weight")).alias("edges"))
    if residuals is not None:
        r = residuals.groupBy("tree_id").agg(F.collect_list(F.struct("t", "node_id", "residual")).alias("residuals"))
        h = h.join(r, "tree_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                s = pd.DataFrame(list(row.edges)).pivot_table(index="node_id", columns="leaf_id", values="weight", aggfunc="sum", fill_value=0.0).sort_index()
                past = None
                if residuals is not None:
                    past = pd.DataFrame(list(row.residuals)).pivot_table(index="t", columns="node_id", values="residual").reindex(columns=s.index).dropna().to_numpy()
                p = projection(s.to_numpy(float), node_weights(s.to_numpy(float), method, past, shrink))
                out.append((row.tree_id, list(s.index), p.tolist()))
            yield pd.DataFrame(out, columns=["tree_id", "nodes", "rows"])

    kinds = {c: hierarchy.schema[c].dataType.simpleString() for c in ("tree_id", "node_id")}
    return h.mapInPandas(run, f"tree_id {kinds['tree_id']}, nodes array<{kinds['node_id']}>, rows array<array<double>>")


def reconcile(base: DataFrame, hierarchy: DataFrame, method: str = "ols", residuals: DataFrame | None = None, shrink: float = 0.2) -> DataFrame:
    """base(tree_id, period, node_id, value), hierarchy(tree_id, node_id, leaf_id, weight), residuals(tree_id, t,
    node_id, residual) -> base with the coherent value added as reconciled. Periods with a missing
    node get null. Periods are groups of their own, as large as a tree."""
    p = projections(hierarchy, method, residuals, shrink)
    x = base.groupBy("tree_id", "period").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "value"))).alias("v")).join(p, "tree_id")
    y = F.transform("nodes", lambda n: F.col("v")[n])
    x = x.withColumn("y", y).withColumn("fixed", F.transform("rows", lambda row: _dot(row, F.col("y"))))
    x = x.select("tree_id", "period", F.explode(F.arrays_zip("nodes", "y", "fixed")).alias("n"))
    fixed = x.select("tree_id", "period", F.col("n.nodes").alias("node_id"), F.col("n.fixed").alias("reconciled"))
    return base.select("tree_id", "period", "node_id", F.col("value").cast("double").alias("value")).join(fixed, ["tree_id", "period", "node_id"], "left")


# --- nested trees -------------------------------------------------------------------------------
DEEPEST = 32


def with_depth(tree: DataFrame) -> DataFrame:
    """(tree_id, node_id, parent_id) -> with depth, 0 at nodes without a parent. A join a level; a node that no root reaches, as
    in a loop, is an error."""
    tree = _cut(tree.select("tree_id", "node_id", "parent_id"))  # read once a level
    now = tree.where("parent_id is null").select("tree_id", "node_id", "parent_id", F.lit(0).alias("depth"))
    found, n, d = [_cut(now)], tree.count(), 0
    while sum(seen := [x.count() for x in found]) < n:
        d += 1
        if d > DEEPEST or not seen[-1]:
            raise ValueError("nodes that no root reaches, or a tree that is too deep")
        above = found[-1].select("tree_id", F.col("node_id").alias("parent_id"))
        found.append(_cut(tree.join(above, ["tree_id", "parent_id"]).select("tree_id", "node_id", "parent_id", F.lit(d).alias("depth"))))
    return _cut(dealt_union(["tree_id", "node_id"], *found))


def _leaves_below(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree_id, node_id, leaves): 1 at a leaf."""
    out, below = [], None
    for d in range(depth, -1, -1):
        here = nodes.where(F.col("depth") == d)
        if below is None:
            here = here.withColumn("leaves", F.lit(1).cast("long"))
        else:
            sums = below.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.sum("leaves").alias("sum"))
            here = here.join(sums, ["tree_id", "node_id"], "left").withColumn("leaves", F.coalesce("sum", F.lit(1)).cast("long")).drop("sum")
        below = here
        out.append(here.select("tree_id", "node_id", "leaves"))
    return dealt_union(["tree_id", "node_id"], *out)


def two_pass(x: DataFrame, depth: int, keys: Sequence[str]) -> DataFrame:
    """x(keys, node_id, parent_id, depth, value, var) -> x with reconciled: the coherent values nearest to value in squares over
    var, exactly, in each tree that the keys tell apart.

    Up: a node's children, summed, are a second measurement of it with the sum of their variances; both are weighed by inverse
    variance. Down: what a parent's final value differs from its children's sum is shared among them by variance. Rows and
    work grow with the nodes; no step sees more than one row of a parent and its children's aggregate."""
    columns = [*keys, "node_id", "parent_id", "depth", "value", "var"]
    levels: list[DataFrame] = []
    for d in range(depth, -1, -1):
        here = x.where(F.col("depth") == d).select(columns)
        if not levels:
            here = here.withColumns({"est": F.col("value"), "spread": F.col("var"), "sum": F.lit(None).cast("double"), "sum_var": F.lit(None).cast("double")})
        else:
            sums = levels[-1].groupBy(*keys, F.col("parent_id").alias("node_id")).agg(F.sum("est").alias("sum"), F.sum("spread").alias("sum_var"))
            here = here.join(sums, [*keys, "node_id"], "left")
            both = 1 / F.col("var") + 1 / F.col("sum_var")
            est = F.coalesce((F.col("value") / F.col("var") + F.col("sum") / F.col("sum_var")) / both, F.col("value"))
            here = here.withColumns({"est": est, "spread": F.coalesce(1 / both, F.col("var"))})
        levels.append(_cut(here))
    out = []
    for here in reversed(levels):
        if not out:
            here = here.withColumn("reconciled", F.col("est"))
        else:
            share = (F.col("reconciled") - F.col("sum")) / F.col("sum_var")
            gaps = out[-1].where("sum_var is not null").select(*keys, F.col("node_id").alias("parent_id"), share.alias("gap"))
            here = here.join(gaps, [*keys, "parent_id"]).withColumn("reconciled", F.col("est") + F.col("spread") * F.col("gap")).drop("gap")
        out.append(here)
    return dealt_union([*keys, "node_id"], *out).select(*columns, "reconciled")


def reconcile_tree(base: DataFrame, tree: DataFrame, method: str = "ols", residuals: DataFrame | None = None, shrink: float = 0.2) -> DataFrame:
    """base(tree_id, period, node_id, value), tree(tree_id, node_id, parent_id: null at the root; without tree_id it is the tree of
    every tree_id of base), residuals(tree_id, t, node_id, residual) -> base with the coherent value as reconciled; every parent is the sum of its children. Trees of many thousands
    of nodes are fine: no matrix over nodes is made.

    ols, wls_struct (variance = leaves below) and wls_var (residual variance) are two_pass(). mint_shrink's covariance is a
    diagonal plus the residuals' outer product, of as low a rank as there are residual times, so it is two_pass() of the
    base and of each time's residuals, and one solve of that rank a tree (the Woodbury identity).

    A period that lacks a node of its tree, or has a null value, gets null; times of residuals that lack one don't count."""
    nodes = with_depth(tree if "tree_id" in tree.columns else tree.withColumn("tree_id", F.lit(0)))
    if "tree_id" not in tree.columns:
        nodes = _cut(base.select("tree_id").distinct().crossJoin(F.broadcast(nodes.select("node_id", "parent_id", "depth"))))  # one small tree
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    size = nodes.groupBy("tree_id").agg(F.count("*").alias("size"))
    if method == "ols":
        weighed = nodes.withColumn("var", F.lit(1.0))
    elif method == "wls_struct":
        weighed = nodes.join(_leaves_below(nodes, depth), ["tree_id", "node_id"]).withColumn("var", F.col("leaves").cast("double")).drop("leaves")
    elif method in ("wls_var", "mint_shrink"):
        if residuals is None:
            raise ValueError(f"{method} needs residuals")
        known = nodes.select("tree_id", "node_id").join(residuals.where("residual is not null"), ["tree_id", "node_id"])
        whole = known.groupBy("tree_id", "t").agg(F.count("*").alias("n")).join(size, "tree_id").where("n = size").select("tree_id", "t")
        known = _cut(known.join(whole, ["tree_id", "t"]).select("tree_id", "t", "node_id", F.col("residual").cast("double").alias("residual")))
        spread = known.groupBy("tree_id", "node_id").agg(F.count("*").alias("n"), F.avg("residual").alias("mean"), F.greatest(F.var_samp("residual"), F.lit(1e-9)).alias("var"))
        if not spread.where("n < 2").isEmpty():
            raise ValueError(f"{method} needs at least two whole times of residuals")
        weighed = nodes.join(spread, ["tree_id", "node_id"])
        if method == "mint_shrink":
            weighed = weighed.withColumn("var", shrink * F.col("var") + 1e-9)
    else:
        raise ValueError(method)
    weighed = _cut(weighed)
    values = _cut(base.select("tree_id", "period", "node_id", F.col("value").cast("double").alias("value")))  # read three times
    complete = values.where("value is not null").join(size, "tree_id").groupBy("tree_id", "period").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n = size").select("tree_id", "period")
    x = values.join(complete, ["tree_id", "period"]).join(weighed, ["tree_id", "node_id"])
    fixed = two_pass(x, depth, ["tree_id", "period"])
    if method == "mint_shrink":
        fixed = _low_rank(fixed, known.join(weighed, ["tree_id", "node_id"]), depth, shrink)
    return values.join(fixed.select("tree_id", "period", "node_id", "reconciled"), ["tree_id", "period", "node_id"], "left")


def _low_rank(fixed: DataFrame, past: DataFrame, depth: int, shrink: float) -> DataFrame:
    """fixed (two_pass of the base under the diagonal part) moved to the full shrunk covariance; past holds the residuals with
    their means. With r the part of a column that two_pass takes away, z solves (r_t . r_s + 1) z = r_t . r_base."""
    times = past.groupBy("tree_id").agg(F.count_distinct("t").alias("times"))
    scaled = past.join(times, "tree_id").withColumn("value", (F.col("residual") - F.col("mean")) * F.sqrt(F.lit(1 - shrink) / (F.col("times") - 1)))
    moved = two_pass(scaled, depth, ["tree_id", "t"])
    taken = ((F.col("value") - F.col("reconciled")) / F.sqrt("var")).alias("r")
    # as many numbers a node as there are residual times
    a = F.array_sort(F.collect_list(F.struct("t", taken, F.col("reconciled").alias("kept"))))
    columns = _cut(moved.groupBy("tree_id", "node_id").agg(a.alias("a")).select("tree_id", "node_id", F.col("a.r").alias("r"), F.col("a.kept").alias("kept")))
    each = columns.select("tree_id", "r", F.posexplode("r").alias("i", "x")).select("tree_id", "i", "x", F.posexplode("r").alias("j", "y"))
    gram = each.groupBy("tree_id", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    gram = gram.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "g"))).alias("g")).select("tree_id", F.col("g.g").alias("g"))

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            solved = []
            for g in pdf["g"]:
                k = math.isqrt(len(g))
                solved.append(np.linalg.inv(np.reshape(np.asarray(g, float), (k, k)) + np.eye(k)).tolist())
            yield pd.DataFrame({"tree_id": pdf["tree_id"], "rows": solved})

    inverse = gram.mapInPandas(invert, f"tree_id {gram.schema['tree_id'].dataType.simpleString()}, rows array<array<double>>")
    met = fixed.join(columns, ["tree_id", "node_id"])
    parts = met.select("tree_id", "period", taken.alias("b"), F.posexplode("r").alias("i", "x")).groupBy("tree_id", "period", "i").agg(F.sum(F.col("b") * F.col("x")).alias("g"))
    right = parts.groupBy("tree_id", "period").agg(F.array_sort(F.collect_list(F.struct("i", "g"))).alias("g")).select("tree_id", "period", F.col("g.g").alias("g"))
    z = right.join(inverse, "tree_id").select("tree_id", "period", F.transform("rows", lambda row: _dot(row, F.col("g"))).alias("z"))
    return met.join(z, ["tree_id", "period"]).withColumn("reconciled", F.col("reconciled") - _dot(F.col("kept"), F.col("z")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def incoherence(values: DataFrame, tree: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, gap): mean |node - sum of its children| over the nodes with children, of values(keys, node_id, value)."""
    joined = values.join(tree, [*(k for k in keys if k in tree.columns), "node_id"])
    sums = joined.groupBy(*keys, F.col("parent_id").alias("node_id")).agg(F.sum(value).alias("sum"))
    return values.join(sums, [*keys, "node_id"]).groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col("sum"))).alias("gap"))


def temporal_tree(spark, fine: int = 96, middle: int = 24) -> DataFrame:
    """One day, its hours and its quarter hours as (node_id, parent_id)."""
    hours = [(f"h{k:02d}", "day") for k in range(middle)]
    quarters = [(f"q{k:02d}", f"h{k // (fine // middle):02d}") for k in range(fine)]
    return spark.createDataFrame([("day", None), *hours, *quarters], "node_id string, parent_id string")


def star_ols(base: DataFrame) -> DataFrame:
    """Closed form for one total over its leaves with equal weights: the gap total - sum(leaves) is shared,
    1 / (n + 1) to each leaf; base(tree_id, period, node_id, is_total, value). Pure aggregation."""
    group = W.partitionBy("tree_id", "period")
    leaf = F.when(~F.col("is_total"), F.col("value"))
    n = F.sum((~F.col("is_total")).cast("int")).over(group)
    total = F.max(F.when(F.col("is_total"), F.col("value"))).over(group)
    part = (total - F.sum(leaf).over(group)) / (n + 1)
    return base.withColumn("reconciled", F.when(F.col("is_total"), F.col("value") - part).otherwise(F.col("value") + part))


def coherence_error(forecasts: DataFrame, hierarchy: DataFrame, value: str) -> DataFrame:
    """Mean |node - weighted sum of its leaves| per tree over nodes that aggregate more than themselves."""
    sums = hierarchy.join(forecasts.select("tree_id", "period", F.col("node_id").alias("leaf_id"), F.col(value).alias("v")), ["tree_id", "leaf_id"])
    sums = sums.groupBy("tree_id", "period", "node_id").agg(F.sum(F.col("v") * F.col("weight")).alias("sum"), F.count("*").alias("k")).where("k > 1")
    return forecasts.join(sums, ["tree_id", "period", "node_id"]).groupBy("tree_id").agg(F.avg(F.abs(F.col(value) - F.col("sum"))).alias("mean_gap"))


def temporal_hierarchy(spark, fine: int = 96, middle: int = 24) -> DataFrame:
    """One day, its hours and its quarter hours as (node_id, leaf_id, weight)."""
    leaf = spark.range(fine).select(F.col("id").cast("int").alias("q"))
    name = lambda kind, c: F.concat(F.lit(kind), F.lpad(c.cast("string"), 2, "0"))
    leaf_id, per = name("q", F.col("q")), fine // middle
    nodes = F.array(F.lit("day"), name("h", F.floor(F.col("q") / per)), leaf_id)
    return leaf.select(F.explode(nodes).alias("node_id"), leaf_id.alias("leaf_id"), F.lit(1.0).alias("weight"))
