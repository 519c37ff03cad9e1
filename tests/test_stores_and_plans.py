"""Stores, sealed ledgers, studies over several settings, and whole requests."""

import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from loadweave.operators import evaluations, ledger, models, relations, studies
from loadweave.plans import service


def hourly(spark, days=45, series=("a", "b")):
    rows = [
        (s, k, 50.0 + 20 * math.sin(2 * math.pi * (k % 24) / 24) + 5 * ((k // 24) % 7 < 5) + (k * 37 % 11) / 10 + 3 * n) for n,
        s in enumerate(series) for k in range(24 * days)
    ]
    df = spark.createDataFrame(rows, "series_id string, k int, value double")
    return df.select("series_id", (F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(hours=F.col("k"))).alias("ts"), "value")


def test_seal():
    assert ledger.seal("ab", b"key") == hmac.new(b"key", b"ab", hashlib.sha256).hexdigest()


def test_forecast_store_replaces_one_day_of_one_utility(spark, tmp_path):
    path = str(tmp_path / "f")
    row = lambda u, d, t: spark.createDataFrame([(u, d, t)], "utility string, forecast_date string, stored_utc long")
    for u, d, t in (("a", "2024-01-01", 1), ("a", "2024-01-02", 2), ("b", "2024-01-01", 3), ("a", "2024-01-01", 4)):
        ledger.save_forecasts(row(u, d, t), path)
    kept = spark.read.parquet(path)
    assert sorted((r["utility"], str(r["forecast_date"]), r["stored_utc"]) for r in kept.collect()) == [("a", "2024-01-01", 4), ("a", "2024-01-02", 2), ("b", "2024-01-01", 3)]
    assert {(r["utility"], str(r["forecast_date"])) for r in ledger.latest_saved(kept).collect()} == {("a", "2024-01-01"), ("b", "2024-01-01")}
    assert ledger.catalogue(spark, {"kept_forecasts": path}) == ["kept_forecasts"] and spark.table("kept_forecasts").count() == 3


def test_issued_forecasts_are_only_added(spark, tmp_path):
    one = spark.createDataFrame(
        [("s", "2024-01-01", 1, [1.0], [2.0], [3.0])],
        "series_id string, target_date string, issued_utc long, p10 array<double>, p50 array<double>, p90 array<double>"
    )
    for k in (1, 2):
        ledger.append_issued(one.withColumn("issued_utc", F.lit(k).cast("long")), str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i"))
    actual = spark.createDataFrame([("s", "2024-01-01", [5.0])], "series_id string, target_date string, actual array<double>")
    assert stored.count() == 2 and ledger.track_record(stored, actual).first()["mae"] == 3.0


def test_prior_store(spark, tmp_path):
    path = str(tmp_path / "p")
    assert ledger.load_prior(spark, path) is None
    for w in ([1.0, 2.0], [3.0, 4.0]):
        ledger.save_prior(spark.createDataFrame([(w, 7)], "weights array<double>, n_series int"), path)
    assert ledger.load_prior(spark, path).collect()[0]["weights"] == [3.0, 4.0]


def test_keep_reference_never_replaces(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2)], "utility string, v int")
    assert ledger.keep_reference(None, new).count() == 2
    assert [r["utility"] for r in ledger.keep_reference(new.where("utility = 'a'"), new).collect()] == ["b"]


def test_positional_pairs_need_equal_lengths(spark):
    a = spark.createDataFrame([(0, 1.0)], "pos int, price double")
    with pytest.raises(ValueError):
        relations.positional_pairs(a, a.union(a))


def test_ratings_must_agree():
    assert studies.single_rating(threshold=None, rating=5.0) == 5.0 and studies.single_rating(a=None) is None
    with pytest.raises(ValueError):
        studies.single_rating(threshold=5.0, rating=5.1)


def test_shoot_out_and_pooling(spark):
    from loadweave.operators import features, resample

    days = resample.daily_matrix(hourly(spark, series=("a", "b", "c")))
    got = studies.shoot_out(days, {"ridge": {}, "small": {"names": features.FEATURES + features.SMALL, "feature_fn": features.small_load_features}}, 3)
    assert {(r["series_id"], r["candidate"]) for r in got.collect()} == {(s, c) for s in "abc" for c in ("ridge", "small")}
    pooled = {(r["series_id"], r["history_days"]): r for r in evaluations.pooling_by_history(days, (7, 14), 3).collect()}
    assert set(pooled) == {(s, k) for s in "abc" for k in (7, 14)}
    # by hand: series a, 14 days
    unit = days.where("series_id = 'a' and day_idx >= 28 and day_idx < 42").agg(F.avg("value")).first()[0]
    own = models.with_vector(features.features(days.where("series_id = 'a'").withColumn("value", F.col("value") / unit)), features.FEATURES)
    w = models.fit_expanding(own.where("day_idx >= 28 and day_idx < 42"), 0, (10.0,), False).select("weights")
    error = own.where("day_idx >= 42").crossJoin(w).agg(F.avg(F.abs(F.col("base") + models.dot("x", "weights") - F.col("value"))) * unit).first()[0]
    assert pooled["a", 14]["mae_own"] == pytest.approx(error) and pooled["a", 14]["mae_pooled"] != pooled["a", 14]["mae_own"]


def test_whole_request(spark):
    series = hourly(spark, 47).where("ts < '2024-04-15'")
    clock = hourly(spark, 47, ("w",))
    weather = clock.select("ts", (F.col("value") / 10).alias("temp"))
    prices = clock.select("ts", (F.col("value") * 2).alias("rebap"), F.col("value").alias("spot"))
    devices = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 8.0)], "feeder_id string, device_id int, demand_kw double")
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    tariff = hours.select(F.lit("a").alias("feeder_id"), "hour", (F.col("hour") % 5 * 0.1).alias("fee"), F.lit(4.0).alias("p_max_kw"), F.lit(20.0).alias("energy_kwh"))
    today = hours.where("hour < 8").select(F.lit("a").alias("series_id"), "hour", F.lit(60.0).alias("actual"))
    ambient = hours.select("hour", F.lit(20.0).alias("ambient_c"))
    out = service.run_forecast(
        series, "UTC", threshold=70.0, rating_kw=70.0, devices=devices, n_test=10, cal_days=8, weather=weather, calibrate=True,
        feedback=True, prices=prices, tariff=tariff, today=today, now_hour=8, ambient=ambient
    )
    counts = {k: v.count() for k, v in out.items()}
    assert counts["forecast"] == 48 and counts["backtest"] == 480 and counts["metrics"] == 6 and counts["bands"] == counts["calibration"] == counts["premium"] == counts["savings"] == 2
    assert counts["intraday"] == 32 and counts["redispatch"] == 24 and counts["tariff"] == 1 and counts["overload"] == 48 and counts["thermal"] == counts["hosting"] == 2 and counts["spread"] == 1
    moved = {r["hour"]: r["shift"] for r in out["intraday"].where("series_id = 'a'").collect()}
    assert len(set(moved.values())) == 1 and moved[9] != 0
    batch = service.daily_batch(series, spark.createDataFrame([("a", "u1"), ("b", "u2")], "series_id string, utility string"), zone="UTC", n_test=3, cal_days=8)
    assert {r["utility"] for r in batch["forecast"].select("utility").distinct().collect()} == {"u1", "u2"}
    plain = service.run_forecast(series, "UTC", n_test=3, cal_days=8, horizon=2)
    assert set(plain) == {"integrity", "validation", "forecast", "backtest", "metrics", "bands"} and plain["forecast"].count() == 96


def test_request_on_residual_load(spark):
    import numpy as np

    load = hourly(spark, 40)
    made = load.withColumn("value", F.col("value") * 0.4 + F.hour("ts") / 3).where("ts < '2024-04-08'")  # generation ends earlier: so does the residual
    devices = spark.createDataFrame([("a", k, 5.0 + k) for k in range(6)], "feeder_id string, device_id int, demand_kw double")
    fee = spark.range(24).select(F.col("id").cast("int").alias("hour"), (F.col("id") % 5 * 0.1).alias("fee"))
    assets = spark.createDataFrame([("p", 1, 9.0, 4.2, 1.0), ("p", 2, 12.0, 4.2, 2.0)], "pool_id string, device_id int, demand_kw double, floor_kw double, weight double")
    caps = spark.createDataFrame([("p", h, 15.0) for h in range(24)], "pool_id string, hour int, cap_kw double")
    options = dict(n_test=8, cal_days=8)
    out = service.run_forecast(
        load, "UTC", threshold=35.0, devices=devices, generation=made, surplus_price=3.0, drift_days=3, dispatch=dict(energy_kwh=60.0, p_max_kw=9.0, fee=fee, beta=0.5),
        pool=(assets, caps), issued_utc="2024-05-01T00:00", audit=True, **options
    )
    counts = {k: v.count() for k, v in out.items()}
    assert {"forecast", "generation_forecast", "residual_forecast", "surplus", "drift", "coverage", "drift_reference", "dispatch", "pool_dispatch", "issued", "audit", "redispatch"} <= set(counts)
    assert counts["forecast"] == counts["residual_forecast"] == counts["generation_forecast"] == counts["dispatch"] == 48 and counts["issued"] == 2
    # each quantity is what a request of its own gives
    alone = {r["hour"]: r for r in service.run_forecast(load, "UTC", **options)["forecast"].where("series_id = 'a'").collect()}
    for r in out["forecast"].where("series_id = 'a'").collect():
        assert (r["local_date"], r["p10"], r["p50"], r["p90"]) == tuple(alone[r["hour"]][c] for c in ("local_date", "p10", "p50", "p90"))
    left = load.join(made.withColumnRenamed("value", "m"), ["series_id", "ts"]).select("series_id", "ts", (F.col("value") - F.col("m")).alias("value"))
    own = {(r["series_id"], r["hour"]): (r["local_date"], r["p50"]) for r in service.run_forecast(left, "UTC", **options)["forecast"].collect()}
    assert {(r["series_id"], r["hour"]): (r["local_date"], r["p50"]) for r in out["residual_forecast"].collect()} == own
    # surplus, drift
    back = out["backtest"].toPandas()
    for r in out["surplus"].collect():
        g = back[back["series_id"] == r["series_id"]]
        e, n = g["actual"] - g["model"], g["actual"] - g["snaive"]
        assert np.isclose(r["more_model"], e.clip(lower=0).sum()) and np.isclose(r["reduction_value"], 3 * (n.abs().sum() - e.abs().sum()))
    for r in out["drift"].collect():
        g = back[back["series_id"] == r["series_id"]]
        late = g["day_idx"] > g["day_idx"].max() - 3
        e = g["actual"] - g["model"]
        assert np.isclose(r["mae_ratio"], e[late].abs().mean() / e[~late].abs().mean())
    stored = out["drift_reference"].where("series_id = 'a'").withColumn("error", F.lit(0.5))
    again = service.drift_parts(out["backtest"], 3, stored)
    assert {r["series_id"] for r in again["drift_reference"].collect()} == {"b"}
    assert {r["series_id"]: round(r["bias_ref"], 9) for r in again["drift"].collect()}["a"] == 0.5
    # the limit holds on the residual load, and what was done is on record
    caps_of = {(r["plan_id"], r["hour"]): r for r in out["dispatch"].collect()}
    assert all(r["grid_safe"] or r["base_kw"] > 35 for r in caps_of.values()) and sum(r["kwh"] for r in caps_of.values() if r["plan_id"] == "a") <= 60 + 1e-6
    entries = out["audit"].cache()
    shed = out["redispatch"].where("shed_kw > 1e-9").count() + sum(r["kwh"] > 1e-9 for r in caps_of.values())
    assert entries.count() == shed and entries.where("ledger_id = 'a'").count() > 0 and ledger.verify(entries).where("not chain_ok").isEmpty()
    longer = service.audit_entries({k: out[k] for k in ("redispatch", "dispatch")}, entries)
    assert ledger.verify(entries.unionByName(longer)).where("chain_ok").count() == entries.select("ledger_id").distinct().count()
    # what was issued is judged when the day has come, and its residual moves the next forecast
    issued = out["issued"].withColumn("p50", F.transform("p50", lambda v: v * 0 + 7.0)).withColumn("target_date", F.lit("2024-04-05"))
    later = service.run_forecast(load, "UTC", feedback=True, issued=issued, **options)
    truth = load.where("date(ts) = '2024-04-05'").toPandas()
    for r in later["track_record"].collect():
        assert np.isclose(r["bias"], (truth[truth["series_id"] == r["series_id"]]["value"] - 7.0).mean()) and r["n"] == 24
    plain = {(r["series_id"], r["hour"]): r for r in service.run_forecast(load, "UTC", feedback=True, digits=None, **options)["forecast"].collect()}
    moved = {(r["series_id"], r["hour"]): r for r in service.run_forecast(load, "UTC", feedback=True, issued=issued, digits=None, **options)["forecast"].collect()}
    assert all(plain[k]["rho"] == moved[k]["rho"] for k in plain)
    if any(r["rho"] for r in plain.values()):
        assert any(not np.isclose(plain[k]["p50"], moved[k]["p50"]) for k in plain)


def test_request_with_prior_and_quarter_hours(spark):
    from loadweave.operators import features, resample

    load = hourly(spark, 30)
    days = resample.daily_matrix(load)
    rows = models.with_vector(features.features(models.normalised(days)), features.FEATURES)
    prior = models.pool_prior(models.fit_expanding(rows, 0)).withColumn("weights", F.transform("weights", lambda w: w * 0 + 0.01))
    got = service.run_forecast(load, "UTC", n_test=3, cal_days=8, prior=prior, digits=None)["forecast"].where("series_id = 'a'").orderBy("hour").collect()
    # by hand, on the series over its mean
    mean = days.where("series_id = 'a'").agg(F.avg("value")).first()[0]
    one = days.where("series_id = 'a'").withColumn("value", F.col("value") / mean)
    x = models.with_vector(features.features(models.append_days(one)), features.FEATURES)
    fit = models.fit_once(x, 8, features.FIRST, (10.0,), True, (0.1, 0.9)).first()
    n = 24 * (fit["cut"] - features.FIRST)
    own = n / (n + 24 * 30.0)
    want = {r["hour"]: mean * (r["base"] + sum((own * w + (1 - own) * 0.01) * v for w, v in zip(fit["weights"], r["x"]))) for r in x.where("value is null").collect()}
    assert all(r["p50"] == pytest.approx(want[r["hour"]]) for r in got) and len(got) == 24
    quarter = load.select("series_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "ts", "value").select("series_id", (F.col("ts") + F.make_dt_interval(mins=15 * F.col("k"))).alias("ts"), (F.col("value") * (1 + F.col("k") / 50)).alias("value"))
    out = service.run_forecast(quarter, "UTC", n_test=3, cal_days=8, temporal=dict(n_test=2, method="wls_struct", cal_days=8, min_history=20))
    assert {(r["series_id"], r["level"]) for r in out["temporal"].collect()} == {(s, k) for s in "ab" for k in ("day", "hour", "quarter")}
    assert all(r["gap_after"] < 1e-9 for r in out["temporal"].collect()) and out["temporal_next"].count() == 242
