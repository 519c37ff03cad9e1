"""Registered queries take every row of their tables: results against plain loops over all rows."""

import pandas as pd
from pyspark.sql import functions as F

from loadweave import plans
from loadweave.operators import control


def level(demands, cap, floor=4.2):
    """The common limit whose clipped demands sum to cap, by bisection."""
    low, high = floor, max(demands)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(x, mid) for x in demands) < cap else (low, mid)
    return low


def test_redispatch_takes_all_orders(spark, sf):
    orders = pd.read_parquet(f"{sf}/orders.parquet")
    feeders = {f: [5.0 + k % 7 for k in g] for f, g in orders.groupby("o_orderpriority")["o_custkey"]}
    threshold = sum(map(sum, feeders.values())) / len(feeders) + 100
    got = {(r["feeder_id"], r["hour"]): r for r in plans.QUERIES["redispatch"](spark, sf).collect()}
    assert len(got) == 24 * len(feeders) and sum(r["congested"] for r in got.values()) > 0
    for (f, hour), r in got.items():
        demands = feeders[f]
        forecast = sum(demands) * (0.8 + hour / 40) + 100
        cap = max(0.0, threshold - (forecast - sum(demands)))
        shed = naive = 0.0
        feasible = True
        if forecast > threshold:
            naive, feasible = sum(x - 4.2 for x in demands), cap >= 4.2 * len(demands)
            most = level(demands, cap) if feasible else 4.2
            shed = sum(x - min(x, most) for x in demands)
        assert (r["congested"], r["feasible"]) == (forecast > threshold, feasible)
        assert abs(r["forecast_kw"] - forecast) < 1e-3 and abs(r["naive_shed_kw"] - naive) < 1e-3 and abs(r["shed_kw"] - shed) < 1e-3


def test_active_setpoints_takes_all_line_items(spark, sf):
    items = pd.read_parquet(f"{sf}/lineitem.parquet")
    want = {}
    for malo, g in items.groupby("l_orderkey"):
        start, least = g["l_shipdate"].min(), g["l_quantity"].min() + 4.2
        for h in range(0, 36, 4):
            limits = [x for a, b, x in ((0, 30, least + 10), (5, 12, least)) if a <= h < b]
            want[malo, str(start + pd.Timedelta(hours=h))[:19]] = min(limits, default=None)
    got = plans.QUERIES["active_setpoints"](spark, sf).collect()
    assert len(got) == len(want) == 9 * items["l_orderkey"].nunique()
    assert {(r["malo"], r["ts"]): r["active_limit_kw"] for r in got} == want


def test_ledger_verify_takes_all_customers(spark, tmp_path):
    orders = pd.DataFrame({"o_custkey": [1, 200, 201, 201, 201, 9000, 9000, 7], "o_orderkey": [1, 2, 3, 97, 101, 206, 5, 202], "o_orderpriority": "1-URGENT", "o_totalprice": 1.5})
    orders.to_parquet(tmp_path / "orders.parquet")
    got = plans.QUERIES["ledger_verify"](spark, str(tmp_path)).collect()
    want = {("1", 1, None, True), ("200", 1, None, True), ("201", 3, 1, False), ("9000", 2, 1, False), ("7", 1, 0, False)}
    assert {(r["ledger_id"], r["n_entries"], r["first_broken"], r["chain_ok"]) for r in got} == want


def test_long_and_short_schedules(spark):
    import random

    rng, day = random.Random(3), 86_400
    points = [(rng.choice("ab"), (s := rng.randrange(3 * 365 * day)), s + rng.choice([1, 1800, 7200, day, 30 * day, 365 * day, 900 * day]), float(rng.randrange(50))) for _ in range(60)]
    points += [("a", 5, 5, 0.0), ("a", 9, 4, 0.0)]  # no duration: never active
    readings = [(rng.choice("abc"), rng.randrange(-day, 5 * 365 * day), k) for k in range(200)]
    readings += [("a", points[0][1], 7), *[("b", points[1][2], 8)] * 3, *[("a", points[0][2] - 1, 9)] * 2]
    stamp = F.timestamp_seconds
    p = spark.createDataFrame(points, "malo string, s long, e long, p_limit_kw double").select("malo", stamp("s").alias("start_ts"), stamp("e").alias("end_ts"), "p_limit_kw")
    r = spark.createDataFrame(readings, "malo string, t long, k int").select("malo", stamp("t").alias("ts"), "t", "k")
    got = control.active_limit(r, p)
    assert got.columns == ["malo", "ts", "t", "k", "active_limit_kw"]
    want = [(m, t, k, min((x for n, a, b, x in points if n == m and a <= t < b), default=None)) for m, t, k in readings]
    assert sorted(map(str, ((x["malo"], x["t"], x["k"], x["active_limit_kw"]) for x in got.collect()))) == sorted(map(str, want))
    plan = control.active_limit(r, p.limit(0))
    assert plan.where("active_limit_kw is null").count() == len(readings)


def test_redispatch_of_any_demands(spark):
    import random

    rng = random.Random(9)
    demand = {f: [round(rng.choice([rng.uniform(0, 4), rng.uniform(4, 30), 11.0]), 3) for _ in range(rng.choice([1, 40, 90]))] for f in range(6)}
    devices = spark.createDataFrame([(f, k, v) for f, d in demand.items() for k, v in enumerate(d)], "feeder_id int, device_id int, demand_kw double")
    hours = spark.createDataFrame([(f, h, sum(d) * (0.4 + h / 20) + 3) for f, d in demand.items() for h in range(24)] + [(99, 0, 1e9)], "feeder_id int, hour int, forecast_kw double")
    for digits in (None, 3):
        for threshold in (20.0, 300.0):
            got = {(r["feeder_id"], r["hour"]): r for r in control.redispatch(hours, devices, threshold, digits=digits, block=8).collect()}
            assert len(got) == 24 * 6
            for (f, h), r in got.items():
                d, fc = demand[f], sum(demand[f]) * (0.4 + h / 20) + 3
                cap, shed, ok = max(0.0, threshold - (fc - sum(d))), 0.0, True
                if fc > threshold:
                    ok = cap >= 4.2 * len(d)
                    low, high = 0.0, max(d)
                    for _ in range(100):
                        mid = (low + high) / 2
                        low, high = (mid, high) if sum(min(x, mid) for x in d) < cap else (low, mid)
                    limits = [min(x, max(high, 4.2)) if ok else 4.2 for x in d]
                    shed = sum(x - (round(v, 3) if digits else v) for x, v in zip(d, limits))
                assert r["feasible"] == ok and abs(r["shed_kw"] - shed) < (0.0011 * len(d) if digits else 1e-6)


def test_greedy_tariff_takes_all_parts(spark, tmp_path):
    part = pd.DataFrame({"p_brand": [f"Brand#{k % 7}" for k in range(1000)], "p_partkey": range(1000), "p_retailprice": [900.0 + k * 37 % 1000 for k in range(1000)], "p_size": [1 + k * 11 % 50 for k in range(1000)]})
    part.to_parquet(tmp_path / "part.parquet")
    got = {r["plan"]: r for r in plans.QUERIES["greedy_tariff"](spark, str(tmp_path)).collect()}
    assert len(got) == 7
    for plan, g in part.groupby("p_brand"):
        hours = [(int(r.p_retailprice + 5) // 10 / 1000, r.p_partkey, min(5.0, 3.0 + r.p_size % 4) if r.p_size % 5 else 0.0) for r in g.itertuples()]
        cost = {}
        for name, order in (("cost", sorted(hours)), ("naive_cost", sorted(hours, key=lambda h: h[1]))):
            left, cost[name] = 40.0, 0.0
            for fee, _, most in order:
                cost[name] += fee * min(most, left)
                left -= min(most, left)
        assert all(abs(got[plan][k] - v) < 2e-6 for k, v in cost.items()) and got[plan]["shortfall_kwh"] == 0
