"""What is not compared, not read again or not fetched: correlations above a threshold, stored moments, filters handed to sources."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.operators import features, models, relations
from loadweave.sources import remote

FETCHED = []


def series_frame(spark, values, drop=lambda name, k: False):
    start = dt.datetime(2024, 1, 1)
    rows = [(name, start + dt.timedelta(hours=k), float(v)) for name, vs in values.items() for k, v in enumerate(vs) if not drop(name, k)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, value double")


@pytest.mark.parametrize("n", [24 * 28, 40, 10])
def test_correlated_pairs_equal_all_pairs(spark, n):
    rng = np.random.default_rng(2)
    t = np.arange(n)
    shapes = [rng.normal() * np.sin(2 * np.pi * t / 24 + rng.uniform(0, 6)) + rng.normal() * np.sin(2 * np.pi * t / (n / 2) + rng.uniform(0, 6)) for _ in range(8)]
    values = {f"s{k:02d}": 5 + shapes[k % 8] * rng.uniform(0.5, 3) * (-1 if k % 11 == 5 else 1) + rng.normal(0, rng.choice([0.02, 0.1, 0.4, 1]), n) for k in range(48)}
    values |= {"copy": values["s00"], "flat": np.full(n, 3.0), "scaled": values["s01"] * 7 - 2}
    df = series_frame(spark, values, lambda name, k: name in ("s03", "s11") and k == 5 or name == "s12" and k < 4)
    df = df.union(spark.createDataFrame([("s01", dt.datetime(2030, 1, 1), None)], df.schema))
    for threshold in (0.98, 0.8):
        every = {(r["a"], r["b"]): (r["overlap"], r["r"]) for r in relations.pair_correlations(df, n // 2).where(F.col("r") >= threshold).collect()}
        got = {(r["a"], r["b"]): (r["overlap"], r["r"]) for r in relations.correlated_pairs(df, threshold, n // 2).collect()}
        assert set(got) == set(every) and all(got[k][0] == v[0] and got[k][1] == pytest.approx(v[1]) for k, v in every.items())
    if n > 100:
        compared = relations.correlation_candidates(df, 0.98, n // 2).where("a not in ('s03', 's11', 's12') and b not in ('s03', 's11', 's12')").count()
        assert compared < 47 * 46 / 2 / 3


def test_moments_are_carried_on(spark):
    rng = np.random.default_rng(4)
    start = dt.date(2024, 1, 1)
    days = [(s, d, start + dt.timedelta(days=d), h, float(50 + 9 * np.sin(h / 4) + 3 * (d % 7) + rng.normal())) for s in "ab" for d in range(30) for h in range(24)]
    rows = models.with_vector(features.features(spark.createDataFrame(days, "series_id string, day_idx int, local_date date, hour int, value double")), features.FEATURES).cache()
    p = len(features.FEATURES)
    want = {(r["series_id"], r["test_day"]): r for r in models.fit_expanding(rows, 12, (10.0,), False).collect()}
    whole = models.running_moments(rows, p).cache()
    got = models.fit_from_moments(whole, 12).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["series_id"], r["test_day"]]
        assert r["n_rows"] == w["n_rows"] and np.allclose(r["weights"], w["weights"], atol=1e-9)
    # one new day: only its rows are read, and the result is the same
    stored = models.running_moments(rows.where("day_idx < 29"), p).cache()
    poisoned = rows.withColumn("target", F.when(F.col("day_idx") < 29, F.lit(1e9)).otherwise(F.col("target")))
    new = models.running_moments(poisoned, p, stored)
    assert {(r["series_id"], r["day_idx"]) for r in new.collect()} == {("a", 29), ("b", 29)}
    again = {(r["series_id"], r["test_day"]): r for r in models.fit_from_moments(stored.unionByName(new), 12).collect()}
    assert all(np.allclose(again[k]["weights"], w["weights"], atol=1e-9) for k, w in want.items())
    # a window of ten days is the difference of two rows
    recent = {(r["series_id"], r["test_day"]): r for r in models.fit_from_moments(whole, 3, window=10).collect()}
    plain = models.fit_expanding(rows.where("day_idx >= 20"), 0, (10.0,), False).collect()
    for r in plain:
        w = recent[r["series_id"], 30]
        assert w["n_rows"] == 240 and np.allclose(r["weights"], w["weights"], atol=1e-7)
    assert models.running_moments(rows.where("day_idx < 0"), p).count() == 0


def fetch(url):
    """Stands for a service; the file beside it says what was asked for."""
    with open("/tmp/loadweave-fetched.txt", "a") as f:
        f.write(url + "\n")
    if url.startswith("w/"):
        first, last = (dt.date.fromisoformat(x) for x in url[2:].split("_"))
        days = [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]
        return json.dumps({"hourly": {"time": [f"{d}T12:00" for d in days], "t": [d.day for d in days]}})
    if url == "index":
        return json.dumps({"timestamps": [k * remote.WEEK_MS for k in range(2800, 2860)]})
    if url.startswith("c/"):
        return json.dumps({"series": [[int(url[2:]) + k * 3_600_000 * 24, k] for k in range(7)]})
    month = url[2:9]
    return json.dumps({"results": [{"day": f"{month}-{k:02d}", "wh": k} for k in (1, 15)]})


def test_filters_prune_requests(spark):
    remote.register(spark)
    here = "tests.test_pruning.fetch"
    weather = dict(url="w/{start}_{end}", columns="t", start="2024-01-01", end="2024-12-31", chunk_days="30", transport=here)
    chunks = dict(index="index", chunk="c/{ts}", start_ms=str(2800 * remote.WEEK_MS), end_ms=str(2860 * remote.WEEK_MS), transport=here)
    pages = dict(url="p/{start}/{limit}/{offset}", fields="day,wh", start="2024-01-01", end="2024-12-31", limit="9", date_field="day", transport=here)
    cases = [
        ("forecast_weather", weather, "ts >= '2024-05-03 00:00:00' and ts < '2024-05-20 00:00:00'", 13, 2),
        ("chunked_series", chunks, "ts > '2024-03-01 00:00:00' and ts <= '2024-03-20 00:00:00'", 61, 6),
        ("paged_records", pages, "day >= '2024-06-10' and day < '2024-07-01'", 12, 2),
    ]

    def asked(name, options, where):
        open("/tmp/loadweave-fetched.txt", "w").close()
        got = sorted(map(str, spark.read.format(name).options(**options).load().where(where).collect()))
        return got, len(set(open("/tmp/loadweave-fetched.txt").read().split()))

    for name, options, where, all_requests, most in cases:
        every, n = asked(name, options, where)
        some, m = asked(name, options | {"prune": "true"}, where)
        assert every == some and len(every) > 0 and n == all_requests and m <= most
    plain, n = asked("forecast_weather", weather | {"prune": "true"}, "t = 3")
    assert n == 13 and len(plain) == 12
