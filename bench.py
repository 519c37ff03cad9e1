"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds per query."""

import json
import os
import time

from loadweave import plans
from loadweave.session import build

HEADLINE = [
    "hourly_spine", "persistence_snaive_mae", "features13", "impute_cascade", "ffill_asof", "imbalance_premium", "psi", "drift_status",
    "water_fill_weighted", "greedy_tariff", "overload_probability", "thermal_path", "rolling_band_scale", "residual_feedback", "corr_pairs",
    "ledger_verify", "ridge_backtest", "next_day_forecast", "bootstrap_skill", "mint_ols", "redispatch", "active_setpoints", "several_days_forecast",
    "base_cqr", "blind_challenge",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm up
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
