"""Hand-computed anchors and properties of the operators."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loadweave.functions import columns as fc
from loadweave.operators import bootstrap, calibration, control, features, integrity, ledger, metrics, models, reconcile, relations, resample, risk


def hourly(spark, values, series="a", start="2024-03-01 00:00:00"):
    rows = [(series, k, None if v is None else float(v)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, k int, value double")
    return df.select("series_id", (F.lit(start).cast("timestamp") + F.make_dt_interval(hours=F.col("k"))).alias("ts"), "value")


def test_gap_report(spark):
    x = hourly(spark, range(8)).where("hour(ts) <> 3")
    assert [r["missing_slots"] for r in integrity.gaps(x).collect()] == [1]


def test_spring_and_autumn_days_are_dropped(spark):
    for start, n in (("2024-03-29 23:00:00", 71), ("2024-10-25 22:00:00", 73)):
        x = resample.daily_matrix(hourly(spark, range(n), start=start), "Europe/Berlin")
        days = {str(r[0]) for r in x.select("local_date").distinct().collect()}
        assert days == ({"2024-03-30", "2024-04-01"} if n == 71 else {"2024-10-26", "2024-10-28"})
        assert {r[0] for r in x.select("day_idx").distinct().collect()} == {0, 1}
        report = integrity.integrity_report(hourly(spark, range(n), start=start), zone="Europe/Berlin").first()
        assert report["n_odd_days"] == 0 and report["n_gaps"] == 0


def test_localize_both_changes(spark):
    rows = [("2024-03-31 02:30:00", False), ("2024-10-27 02:30:00", False), ("2024-10-27 02:30:00", True), ("2024-07-01 12:00:00", True)]
    df = spark.createDataFrame(rows, "t string, late boolean").select(fc.localize(F.col("t").cast("timestamp"), F.col("late")).alias("u"))
    got = [r[0] for r in df.select(F.date_format("u", "MM-dd HH:mm").alias("s")).collect()]
    assert got == ["03-31 01:00", "10-27 00:30", "10-27 01:30", "07-01 10:00"]


def test_forward_fill(spark):
    left = spark.sql("select 's' series_id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 15) ts from range(8)")
    right = hourly(spark, [1, 2], "s", "2024-01-01 00:00:00")
    got = [r["asof_value"] for r in resample.as_of(left, right).orderBy("ts").collect()]
    assert got == [1.0] * 4 + [2.0] * 4


def test_quarter_hours_are_period_end(spark):
    x = spark.sql("select 's' series_id, timestamp'2024-01-01 00:15:00' + make_dt_interval(0, 0, id * 15) ts, cast(id as double) value from range(100)")
    m = resample.quarter_hour_matrix(x)
    assert m.count() == 96 and m.agg(F.max("slot")).first()[0] == 95


def test_contiguous_blocks_need_even_steps(spark):
    assert resample.contiguous_blocks(hourly(spark, range(50))).count() == 48
    assert resample.contiguous_blocks(hourly(spark, range(50)).where("value <> 7")).count() == 0


def test_imputation_order(spark):
    v = [float(k % 24) for k in range(96)]
    x = hourly(spark, v).withColumn("good", ~F.col("value").isin(5.0) | (F.dayofmonth("ts") != 2))
    r = integrity.impute(x).where("not good").first()
    assert r["filled"] == 5.0 and r["method"] == "seasonal"
    y = hourly(spark, [1, 2, None, 4, 5]).withColumn("good", F.col("value").isNotNull())
    assert [(q["filled"], q["method"]) for q in integrity.impute(y).where("not good").collect()] == [(3.0, "line")]
    z = hourly(spark, [None] * 5).withColumn("good", F.lit(False))
    assert {q["method"] for q in integrity.impute(z).collect()} == {"unreplaceable"}


def test_validation_gate(spark):
    ok = hourly(spark, [10.0] * 30 + [-5.0] + [10.0] * 30)
    assert integrity.validate(ok).where("applied").count() == 61


def test_psi_and_ks_of_equal_samples(spark):
    x = spark.range(200).select(F.lit("g").alias("g"), (F.col("id") % 100).cast("double").alias("error"), (F.col("id") >= 100).alias("recent"))
    r = metrics.drift_report(x, ["g"]).first()
    assert abs(r["psi"]) < 1e-9 and r["ks"] == 0 and r["status"] == "stable"


def test_premium_anchor(spark):
    rows = [("g", 0.0, e, s, 0.0) for e, s in zip([2.0, 2.0, -2.0, -2.0], [50.0, 50.0, -50.0, -50.0])]
    df = spark.createDataFrame(rows, "g string, f double, a double, rebap double, spot double")
    r = metrics.imbalance_premium(df, ["g"], "f", "a", "rebap", "spot").first()
    assert (r["total"], r["bias_part"], r["correlation_part"]) == (400.0, 0.0, 400.0)


def test_mmm_anchor(spark):
    df = spark.createDataFrame([("g", 10.0, a) for a in (12.0, 12.0, 8.0, 8.0)], "g string, f double, a double")
    r = metrics.surplus_deficit(df, ["g"], "f", "a").first()
    assert (r["more"], r["less"], r["net"], r["volume"]) == (4.0, 4.0, 0.0, 8.0)


def test_tariff_anchor(spark):
    df = spark.createDataFrame(
        [("p", h, fee, 10.0, 10.0, True, 15.0) for h, fee in enumerate([0.10, 0.05, 0.20, 0.05])],
        "plan string, hour int, fee double, p_max_kw double, cap_kw double, available boolean, energy_kwh double"
    )
    r = control.tariff_summary(control.tariff_placement(df, ["plan"]), ["plan"]).first()
    assert r["cost"] == pytest.approx(0.75) and r["saving"] == pytest.approx(0.50) and r["shortfall_kwh"] == 0


def test_pool_anchor(spark):
    df = spark.createDataFrame([(c, i, 10.0, c * 1.0) for c in (24, 10) for i in range(3)], "pool int, device_id int, demand_kw double, cap_kw double")
    got = control.water_fill(df, ["pool"]).orderBy("pool", "device_id").collect()
    assert [r["limit_kw"] for r in got] == [4.2] * 3 + [8.0] * 3
    assert [r["feasible"] for r in got] == [False] * 3 + [True] * 3


def test_water_fill_meets_cap(spark):
    df = spark.sql("select id % 7 g, id device_id, cast(1 + hash(id) % 9 + 10 as double) demand_kw, 1.0D floor_kw, cast(1 + id % 3 as double) weight from range(200)")
    df = df.where("demand_kw >= 1").withColumn("cap_kw", F.lit(150.0))
    for out in (control.water_fill(df, ["g"], 1.0), control.weighted_fill(df, ["g"])):
        s = out.groupBy("g").agg(F.sum("limit_kw").alias("l"), F.sum("demand_kw").alias("d"), F.first("feasible").alias("f")).collect()
        for r in s:
            assert r["l"] == pytest.approx(min(150.0, r["d"]), abs=0.05)


def test_overload_anchor(spark):
    df = spark.createDataFrame(
        [("a", 0, 100.0, [-10.0, -5.0, 0.0, 5.0, 10.0, 15.0, 20.0], 110.0)],
        "asset_id string, hour int, point_kw double, residuals array<double>, rating_kw double"
    )
    r = risk.overload(df).first()
    assert r["p_overload"] == pytest.approx(2 / 7) and r["expected_excess_kwh"] == pytest.approx(15 / 7) and r["p90_kw"] == pytest.approx(117)


def test_hosting_anchor(spark):
    df = spark.createDataFrame(
        [("a", 0, 100.0, [-20.0, -10.0, 0.0, 10.0, 20.0], 150.0)],
        "asset_id string, hour int, point_kw double, residuals array<double>, rating_kw double"
    )
    assert risk.hosting_capacity(df, 0.2).first()["hosting_kw"] == 40.0


def test_fleet_anchor(spark):
    rows = spark.createDataFrame(
        [("a", h, 0.0, [0.0], 500.0) for h in range(24)],
        "asset_id string, hour int, point_kw double, residuals array<double>, rating_kw double"
    )
    fleets = spark.createDataFrame(
        [("ev", 1.0, 50.0, 4.0, 0.8, [1.0] * 24)],
        "fleet string, sign double, units double, rated_kw double, coincidence double, profile array<double>"
    )
    assert risk.fleet_scenario(rows, fleets).agg(F.max("point_kw")).first()[0] == pytest.approx(160)


def test_thermal_anchor(spark):
    df = spark.createDataFrame([("a", [100.0] * 24, [20.0] * 24, 100.0)], "asset_id string, load_kw array<double>, ambient_c array<double>, rating_kw double")
    r = risk.thermal_path(df).first()
    assert r["peak_c"] == pytest.approx(98.0) and r["loss_h"] == pytest.approx(24.0)


def test_mint_anchor(spark):
    base = spark.createDataFrame([("t", 0, n, v) for n, v in (("total", 10.0), ("a", 4.0), ("b", 5.0))], "tree_id string, period int, node_id string, value double")
    h = spark.createDataFrame(
        [("t", n, leaf, 1.0) for n, leaf in (("total", "a"), ("total", "b"), ("a", "a"), ("b", "b"))],
        "tree_id string, node_id string, leaf_id string, weight double"
    )
    want = {"total": 29 / 3, "a": 13 / 3, "b": 16 / 3}
    for got in (reconcile.reconcile(base, h), reconcile.star_ols(base.withColumn("is_total", F.col("node_id") == "total"))):
        assert {r["node_id"]: pytest.approx(r["reconciled"]) for r in got.collect()} == want
    fixed = reconcile.reconcile(base, h).select("tree_id", "period", "node_id", F.col("reconciled").alias("v"))
    assert reconcile.coherence_error(fixed, h, "v").first()["mean_gap"] < 1e-9


def test_temporal_hierarchy(spark):
    h = reconcile.temporal_hierarchy(spark)
    assert h.select("node_id").distinct().count() == 121 and h.count() == 3 * 96


def test_intraday_anchor(spark):
    df = spark.createDataFrame(
        [("s", 0, h, a, 0.0, 0.0, 0.0) for h, a in ((0, 1.0), (1, 1.5), (2, None))],
        "series_id string, day int, hour int, actual double, p10 double, p50 double, p90 double"
    )
    w = 0.5 ** (1 / 3)
    assert calibration.intraday(df, 2).first()["shift"] == pytest.approx(0.5 * (w * 1.0 + 1.5) / (w + 1))


def test_ledger_detects_change(spark):
    e = spark.createDataFrame([("l", k, f"p{k}") for k in range(5)], "ledger_id string, seq int, payload string")
    good = ledger.chain(e)
    assert ledger.verify(good).first()["chain_ok"]
    bad = good.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload")))
    r = ledger.verify(bad).first()
    assert not r["chain_ok"] and r["first_broken"] == 3
    new = spark.createDataFrame([("l", 0, "next"), ("m", 0, "first")], "ledger_id string, seq int, payload string")
    assert ledger.verify(good.unionByName(ledger.append(good, new))).where("chain_ok").count() == 2
    with pytest.raises(ValueError):
        ledger.append(bad, new)


def test_sign_test(spark):
    r = metrics.sign_test(spark.createDataFrame([(8, 10)], "w int, n int"), "w", "n").first()
    assert r["p_value"] == pytest.approx(sum(math.comb(10, k) for k in (8, 9, 10)) / 1024)


def test_holidays(spark):
    got = {r["holiday"] for r in relations.holidays(spark.sql("select 2025 year"), "NW").collect()}
    assert date(2025, 4, 21) in got and date(2025, 6, 19) in got and date(2025, 11, 1) in got and len(got) == 11


def test_features_never_see_their_own_day(spark):
    v = [math.sin(k / 5) * 10 + k % 24 for k in range(24 * 20)]
    a = resample.daily_matrix(hourly(spark, v))
    b = resample.daily_matrix(hourly(spark, v[: 24 * 19] + [x + 1000 for x in v[24 * 19 :]]))
    cols = [*features.FEATURES, *features.SMALL]
    x, y = (features.small_load_features(d).where("day_idx = 19").orderBy("hour").select(*cols).collect() for d in (a, b))
    assert x == y and len(x) == 24


def test_ridge_equals_direct_solve(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.c_[np.ones(300), rng.normal(size=(300, 4)), np.full(300, 3.0)]
    y = x @ np.array([1.0, 2, -1, 0.5, 0, 0]) + rng.normal(size=300) * 0.1
    rows = [("s", k // 24, k % 24, x[k].tolist(), float(y[k])) for k in range(288)]
    df = spark.createDataFrame(rows, "series_id string, day_idx int, hour int, x array<double>, target double")
    got = np.array(models.fit_expanding(df, 2, (10.0,), shrunk=False).where("test_day = 11").first()["weights"])
    xt, yt = x[: 11 * 24], y[: 11 * 24]
    mu, sd = xt.mean(0), xt.std(0)
    mu[0], sd[0], sd[5] = 0, 1, 1
    z = (xt - mu) / sd
    pen = 10.0 * np.eye(6)
    pen[0, 0] = 0
    w = np.linalg.solve(z.T @ z + pen, z.T @ yt)
    assert np.allclose(xt @ got, z @ w, atol=1e-8)


def test_forecast_and_horizon(spark):
    v = [50 + 20 * math.sin(2 * math.pi * (k % 24) / 24) + 5 * ((k // 24) % 7 < 5) + (k * 37 % 11) / 10 for k in range(24 * 40)]
    d = resample.daily_matrix(hourly(spark, v))
    f = models.next_day(d, cal_days=10).collect()
    assert len(f) == 24 and all(r["p10"] <= r["p50"] <= r["p90"] for r in f)
    assert {r["local_date"] for r in f} == {date(2024, 4, 10)}
    s = models.horizon_scores(d, 2, 2, cal_days=7).orderBy("horizon").collect()
    assert [r["n"] for r in s] == [48, 48]


def test_bootstrap_is_reproducible(spark):
    x = spark.sql("select 's' series_id, cast(id as int) day_idx, cast(1 + id % 3 as double) m, cast(2 + id % 2 as double) r from range(40)")
    a, b = (bootstrap.skill_interval(x.repartition(k), ["series_id"], "m", "r", n=200).first() for k in (1, 5))
    assert a == b and a["ci_low"] <= a["skill"] <= a["ci_high"]
    assert bootstrap.difference_interval(x, ["series_id"], "r", "m", n=50).first()["improvement"] == pytest.approx(a["skill"])


def test_drop_rows_in_order(spark):
    assert [str(r["holiday"]) for r in relations.override_holidays(*(spark.sql(f"select explode(array({x})) holiday") for x in ("date'2024-01-01', date'2024-05-01'", "date'2024-06-01'", "date'2024-06-01', date'2024-01-01'"))).collect()] == ["2024-05-01"]


def test_schedule_validation(spark):
    df = spark.createDataFrame(
        [("DE123456", datetime(2024, 1, 1), datetime(2024, 1, 1, 1), 5.0, None), ("X", datetime(2024, 1, 1), datetime(2024, 1, 1), 3.0, None)],
        "malo string, start_ts timestamp, end_ts timestamp, p_limit_kw double, floor_kw double"
    )
    got = {r["malo"]: r["errors"] for r in control.validate_schedule(df).collect()}
    assert got == {"DE123456": [], "X": ["short_id", "below_floor", "no_duration"]}
    assert control.to_lpc(df).where("malo = 'DE123456'").first()["limit_w"] == 5000
    r = control.receive(df.withColumn("desired_kw", F.lit(9.0))).collect()
    assert [(x["accepted"], x["applied_kw"]) for x in r] == [(True, 5.0), (False, None)]


def test_plan_day(spark):
    df = spark.createDataFrame(
        [("p", h, 20.0, [-1.0, 0.0, 1.0], f, 10.0, 15.0) for h, f in enumerate([0.3, 0.1, 0.2])],
        "plan_id string, hour int, base_kw double, residuals array<double>, fee double, p_max_kw double, energy_kwh double"
    )
    got = control.plan_day(df, 28.0, 1.0, 1.0).orderBy("hour").collect()
    assert [r["kwh"] for r in got] == [0.0, 8.0, 7.0] and all(r["grid_safe"] for r in got)
