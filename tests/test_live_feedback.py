"""The feedback stream, cut in any way, against the batch operator."""

import os
import random

import pytest

from loadweave.operators.calibration import residual_feedback
from loadweave.streaming.feedback import ROCKS, daily_feedback

SCHEMA = "series_id string, day int, hour int, p50 double, actual double"
OPTIONS = {"window": 6, "least": 3}


def series(rng):
    """Days missing one by one and for longer than the window, hours missing, null values; b starts late."""
    rows, wave = [], 0.0
    for day in range(40):
        for s in "ab":
            if s == "a" and day in (9, 10, 17) or s == "b" and (day < 5 or 15 <= day < 28):
                continue
            for hour in range(4):
                wave = 0.8 * wave + rng.gauss(0, 1)
                if rng.random() < 0.95:
                    rows.append((s, 20_000 + day, hour, float(rng.randrange(50)), None if rng.random() < 0.05 else 25 + wave))
    return rows


@pytest.mark.parametrize("cuts", [1, 4, 15])
def test_any_cut_equals_the_batch(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    rows = series(random.Random(3))
    at = sorted(rng.sample(range(1, len(rows)), cuts - 1))
    src = tmp_path / "in"
    src.mkdir()
    for k, (a, z) in enumerate(zip([0, *at], [*at, len(rows)])):
        spark.createDataFrame(rows[a:z], SCHEMA).toPandas().astype({"day": "int32", "hour": "int32"}).to_parquet(src / f"{k:03d}.parquet")
        os.utime(src / f"{k:03d}.parquet", (1_700_000_000 + 60 * k,) * 2)
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, ROCKS)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
        found = daily_feedback(stream, late="0 hours", **OPTIONS)
        out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(200)
    finally:
        spark.conf.unset(provider)
    got = {(r["series_id"], r["day"], r["hour"]): r for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == len(got)
    want = residual_feedback(spark.createDataFrame(rows, SCHEMA), **OPTIONS).collect()
    firsts = {s: min(d for x, d, *_ in rows if x == s) for s in "ab"}
    moved = 0
    for r in want:
        g = got.get((r["series_id"], r["day"], r["hour"]))
        if g is None:  # before the first day is over, after long silence, or an hour never heard before
            assert r["delta"] == 0
            continue
        assert g["rho"] == pytest.approx(r["rho"]) and r["day"] > firsts[r["series_id"]]
        assert g["rho"] * (g["residual"] or 0.0) == pytest.approx(r["delta"])
        moved += r["delta"] != 0
    assert moved > 50
    silent = {d - 20_000 for s, d, _ in got if s == "b"}
    assert set(range(6, 21)) <= silent and not silent & set(range(23, 29))  # days without rows are served while the window holds any
