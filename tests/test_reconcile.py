"""Tree reconciliation in two passes against the dense projection, and temporal reconciliation of fitted forecasts against loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.operators import models, reconcile, studies


def a_tree(rng, depth=3):
    """(node, parent) pairs of a random tree whose leaves are at different depths."""
    edges, level = [("r", None)], ["r"]
    for d in range(depth):
        nxt = []
        for node in level:
            for k in range(rng.integers(2, 4) if d == 0 or rng.random() < 0.8 else 0):
                edges.append((f"{node}{k}", node))
                nxt.append(f"{node}{k}")
        level = nxt
    return edges


def summing(edges):
    parents = {p for _, p in edges}
    leaves = [n for n, _ in edges if n not in parents]
    nodes, up = [n for n, _ in edges], dict(edges)
    s = np.zeros((len(nodes), len(leaves)))
    for j, leaf in enumerate(leaves):
        while leaf is not None:
            s[nodes.index(leaf), j] = 1
            leaf = up[leaf]
    return nodes, s


@pytest.mark.parametrize("method", ["ols", "wls_struct", "wls_var", "mint_shrink"])
def test_trees_equal_the_dense_projection(spark, method):
    rng = np.random.default_rng(4)
    trees, base, residuals, want = [], [], [], {}
    for k in range(3):
        edges = a_tree(rng)
        nodes, s = summing(edges)
        trees += [(k, *e) for e in edges]
        r = rng.normal(size=(7, len(nodes))) * rng.uniform(0.5, 3, len(nodes)) + rng.normal(size=(7, 1))
        residuals += [(k, t, n, float(v)) for t in range(7) for n, v in zip(nodes, r[t])] + [(k, 99, nodes[0], 1000.0), (k, 98, nodes[0], None)]
        p = reconcile.projection(s, reconcile.node_weights(s, method, r))
        for period in ("a", "b"):
            y = rng.uniform(1, 9, len(nodes))
            base += [(k, period, n, float(v)) for n, v in zip(nodes, y)]
            want |= {(k, period, n): v for n, v in zip(nodes, p @ y)}
        base += [(k, "short", n, 1.0) for n in nodes[1:]] + [(k, "null", n, None if n == nodes[-1] else 1.0) for n in nodes]
    base_df = spark.createDataFrame(base, "tree_id int, period string, node_id string, value double")
    tree = spark.createDataFrame(trees, "tree_id int, node_id string, parent_id string")
    past = spark.createDataFrame(residuals, "tree_id int, t int, node_id string, residual double")
    got = reconcile.reconcile_tree(base_df, tree, method, past).collect()
    assert len(got) == len(base)
    for r in got:
        v = want.get((r["tree_id"], r["period"], r["node_id"]))
        assert r["reconciled"] is None if v is None else r["reconciled"] == pytest.approx(v, abs=1e-8)
    one = base_df.where("tree_id = 0")
    shared = reconcile.reconcile_tree(one.withColumn("tree_id", F.lit("x")), tree.where("tree_id = 0").drop("tree_id"), "ols")
    assert shared.count() == one.count()


def test_ten_thousand_leaves(spark):
    n, groups = 10_000, 100
    leaf = spark.range(n).select(F.concat(F.lit("l"), "id").alias("node_id"), F.concat(F.lit("g"), F.col("id") % groups).alias("parent_id"))
    mid = spark.range(groups).select(F.concat(F.lit("g"), "id").alias("node_id"), F.lit("all").alias("parent_id"))
    tree = leaf.union(mid).union(spark.createDataFrame([("all", None)], "node_id string, parent_id string"))
    base = tree.crossJoin(spark.createDataFrame([(1,), (2,)], "period int")).withColumn("value", F.rand(3) * F.when(F.col("node_id") == "all", n / 2).when(F.col("node_id").startswith("g"), n / groups / 2).otherwise(1.0))
    base = base.select(F.lit("t").alias("tree_id"), "period", "node_id", "value").cache()
    past = tree.crossJoin(spark.range(6)).select(F.lit("t").alias("tree_id"), F.col("id").alias("t"), "node_id", (F.randn(5) + F.randn(6)).alias("residual")).cache()
    for method in ("wls_struct", "mint_shrink"):
        got = reconcile.reconcile_tree(base, tree, method, past).select("tree_id", "period", "node_id", F.col("reconciled").alias("v"))
        gaps = reconcile.incoherence(got, tree, ["tree_id", "period"], "v").collect()
        assert len(gaps) == 2 and all(r["gap"] < 1e-9 for r in gaps)


def test_what_is_no_tree(spark):
    base = spark.createDataFrame([(1, 1, "a", 1.0)], "tree_id int, period int, node_id string, value double")
    loop = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "tree_id int, node_id string, parent_id string")
    with pytest.raises(ValueError):
        reconcile.reconcile_tree(base, loop)
    alone = spark.createDataFrame([(1, "a", None)], "tree_id int, node_id string, parent_id string")
    assert reconcile.reconcile_tree(base, alone).first()["reconciled"] == 1.0
    for method in ("wls_var", "other"):
        with pytest.raises(ValueError):
            reconcile.reconcile_tree(base, alone, method)


def test_temporal_reconciliation_of_fitted_forecasts(spark):
    rng = np.random.default_rng(8)
    n, cal, first_target = 34, 10, 22
    shape = 20 + 6 * np.sin(np.arange(96) / 96 * 2 * np.pi)
    load = shape * (1 + 0.2 * rng.random((n, 1))) + np.cumsum(rng.normal(0, 0.3, (n, 96)), 0)
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(n)]
    rows = [("s@1", k, dates[k], q, float(load[k, q])) for k in range(n) for q in range(96)]
    rows += [("s@1", n, dates[-1] + dt.timedelta(days=1), q, 1.0) for q in range(50)]  # not whole: no day
    df = spark.createDataFrame(rows, "series_id string, day_idx int, local_date date, slot int, value double")
    options = dict(cal_days=cal, min_history=first_target)
    out = studies.temporal_reconciliation(df, 4, "mint_shrink", 5, **options)

    levels = {"day": load.sum(1, keepdims=True), "hour": load.reshape(n, 24, 4).sum(2), "quarter": load}

    def forecast(x, d):
        """The day d from the days before it, as a loop over days would make it."""
        x = x[:d]
        cut = d - cal if d - cal > 10 else d
        feats = lambda k: slot_matrix(np.vstack([x, x[:1]]), k)
        xs, ys = np.vstack([feats(k) for k in range(8, cut)]), np.concatenate([x[k] - x[k - 7] for k in range(8, cut)])
        m = models._Moments(xs, ys)
        s, w = models._shrunk_fit(m, len(ys), 10.0, True)
        return x[d - 7] + feats(d) @ (s * w)

    def slot_matrix(x, d):
        k = x.shape[1]
        prev, h, dow = x[d - 1] - x[d - 8], np.arange(k) * 2 * np.pi / k, (dates[0] + dt.timedelta(days=d)).weekday()
        cols = [1, prev, prev.mean(), prev.mean(), x[d - 1] - x[d - 7], np.sin(h), np.cos(h), np.sin(2 * h), np.cos(2 * h), np.sin(2 * np.pi * dow / 7), np.cos(2 * np.pi * dow / 7), float(dow >= 5), 0.0]
        return np.stack([np.broadcast_to(c, k) for c in cols], 1).astype(float)

    all_nodes = lambda d: np.concatenate([forecast(x, d) for x in levels.values()])
    truth = lambda d: np.concatenate([x[d] for x in levels.values()])
    s = np.vstack([np.ones((1, 96)), np.kron(np.eye(24), np.ones((1, 4))), np.eye(96)])

    def fixed(days, past):
        r = np.array([truth(d) - all_nodes(d) for d in past])
        p = reconcile.projection(s, reconcile.node_weights(s, "mint_shrink", r))
        return {d: p @ all_nodes(d) for d in days}

    tested = range(n - 4, n)
    after = fixed(tested, range(n - 9, n - 4))
    got = {r["level"]: r for r in out["backtest"].collect()}
    parts = {"day": slice(0, 1), "hour": slice(1, 25), "quarter": slice(25, 121)}
    for level, part in parts.items():
        a = np.concatenate([truth(d)[part] for d in tested])
        b, c = np.concatenate([all_nodes(d)[part] for d in tested]), np.concatenate([after[d][part] for d in tested])
        assert got[level]["series_id"] == "s@1" and got[level]["n"] == len(a)
        assert got[level]["mae_before"] == pytest.approx(np.abs(a - b).mean(), rel=1e-6) and got[level]["mae_after"] == pytest.approx(np.abs(a - c).mean(), rel=1e-6)
        assert got[level]["mape_after"] == pytest.approx(100 * np.abs((a - c) / a).mean(), rel=1e-6)
        assert got[level]["gap_before"] > 1e-3 and got[level]["gap_after"] < 1e-9
    ahead = {r["node_id"]: r for r in out["next"].collect()}
    want = fixed([n], range(n - 5, n))[n]
    names = ["day", *(f"h{k:02d}" for k in range(24)), *(f"q{k:02d}" for k in range(96))]
    assert len(ahead) == 121 and {r["local_date"] for r in ahead.values()} == {dates[-1] + dt.timedelta(days=1)}
    for name, v, y in zip(names, want, all_nodes(n)):
        assert ahead[name]["value"] == pytest.approx(y, abs=1e-6) and ahead[name]["reconciled"] == pytest.approx(v, abs=1e-6)
