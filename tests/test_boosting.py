"""Boosted quantile trees against a plain loop, and on the driver's loads against linear quantiles."""


import numpy as np
from pyspark.sql import functions as F

from loadweave.operators import boosting, features, models
from loadweave.plans import inputs


def brute(x, y, train, level, rounds, depth, rate, bins, least):
    edges = [sorted(set(np.sort(x[train, f])[[int(np.ceil(k / bins * train.sum())) - 1 for k in range(1, bins)]])) for f in range(x.shape[1])]
    b = np.array([[sum(e < v for e in edges[f]) for f, v in enumerate(row)] for row in x])
    pred = np.full(len(y), np.quantile(y[train], level))
    for _ in range(rounds):
        node = np.ones(len(y), int)
        for _ in range(depth):
            moved = 2 * node
            for k in np.unique(node[train]):
                own = train & (node == k)
                g = level - (y < pred)
                best = None
                for f in range(x.shape[1]):
                    for cut in np.unique(b[own, f]):
                        left = own & (b[:, f] <= cut)
                        right = own & ~left
                        if left.sum() >= least and right.sum() >= least:
                            gain = round(sum(g[s].sum() ** 2 / s.sum() for s in (left, right)) - g[own].sum() ** 2 / own.sum(), 9)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, f, cut)
                if best:
                    moved[(node == k) & (b[:, best[1]] > best[2])] += 1
            node = moved
        step = {k: np.quantile((y - pred)[train & (node == k)], level) for k in np.unique(node[train])}
        pred = pred + rate * np.array([step.get(k, 0.0) for k in node])
    return pred


def test_boosted_quantiles_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for s in ("a", "b"):
        x = np.round(rng.normal(size=(20 * 24, 3)), 2)
        x[:, 2] = np.arange(480) % 24
        y = 3 * (x[:, 0] > 0.3) + x[:, 1] * (x[:, 2] > 12) + rng.normal(0, 0.3, 480)
        train = np.arange(480) < 15 * 24
        train[7] = False
        p = np.sort([brute(x, y, train, q, 3, 2, 0.5, 8, 15) for q in (0.1, 0.9)], axis=0)
        for k in range(480):
            rows.append((s, k // 24, k % 24, [float(v) for v in x[k]], 10.0, None if k == 7 else float(y[k]), "kept"))
            want[s, k // 24, k % 24] = p[:, k]
    df = spark.createDataFrame(rows, "series_id string, day_idx int, hour int, x array<double>, base double, target double, other string")
    got = boosting.boosted_quantiles(df, (0.1, 0.9), 15, 3, 2, 0.5, 8, 15, "target", ())
    assert got.columns == [*df.columns, "p10", "p90"]
    first = got.collect()
    assert len(first) == len(rows) and all(np.allclose((r["p10"], r["p90"]), want[r["series_id"], r["day_idx"], r["hour"]]) for r in first)
    again = boosting.boosted_quantiles(df.repartition(7), (0.1, 0.9), 15, 3, 2, 0.5, 8, 15, "target", ()).collect()
    assert sorted(map(str, again)) == sorted(map(str, first))
    assert boosting.boosted_quantiles(df.where("target is null"), (0.5,), rounds=1, target="target").count() == 0


def pinball(df, days):
    loss = lambda q, c: F.greatest(q * (F.col("value") - F.col(c)), (q - 1) * (F.col("value") - F.col(c)))
    return df.where(F.col("day_idx") >= days).agg(F.avg(loss(0.1, "p10") + loss(0.5, "p50") + loss(0.9, "p90"))).first()[0] / 3


def test_no_worse_than_linear_quantiles(spark):
    days = inputs.days(spark, "/root/testdata/sf0.01")
    rows = models.with_vector(features.features(days), features.FEATURES).cache()
    cut = rows.agg(F.max("day_idx")).first()[0] - 6
    boosted = pinball(boosting.boosted_quantiles(rows, train_until=cut), cut)
    linear = pinball(models.quantile_forecast(rows, train_until=cut), cut)
    assert boosted < 0.9 * linear  # 28.8 and 35.8
