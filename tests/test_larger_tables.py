"""Faults that show on larger tables, brought about on small ones by settings or made rows."""

import math
import re

import duckdb
import pandas as pd
import pytest
from tests.compare import duck, rows

from loadweave import plans
from loadweave.operators import control, metrics
from loadweave.sources import text_series

# what a default session does on large tables: partitions of one side of a union are merged, those of the other are not
MERGED = {
    "spark.sql.unionOutputPartitioning": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def merged(spark):
    old = {k: spark.conf.get(k, None) for k in MERGED}
    for k, v in MERGED.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def same_as_sql(spark, sf, name):
    got = plans.QUERIES[name](spark, sf).toPandas()
    assert rows(got) == rows(duck(sf).execute(plans.SQL[name]).fetch_df())


def test_csv_files_are_one_file_a_name(spark, sf, merged):
    same_as_sql(spark, sf, "csv_files")


def test_csv_inspection_sees_the_header(spark, sf, merged):
    same_as_sql(spark, sf, "csv_inspection")


@pytest.mark.parametrize("name", ["csv_files", "csv_inspection"])
def test_no_file_is_read_as_one_value(spark, sf, name):
    """Spark reads no binary value beyond this limit, 2 GB by default."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        same_as_sql(spark, sf, name)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_excel_is_refused_by_its_first_bytes(spark, tmp_path):
    for k, head in enumerate((b"PK\x03\x04\x14", b"\xd0\xcf\x11\xe0\xa1")):
        (tmp_path / f"{k}.csv").write_bytes(head + bytes(range(256)) * 9)
        with pytest.raises(ValueError, match="Excel"):
            text_series.read_text(spark, str(tmp_path / f"{k}.csv"))


def test_csv_inspection_sorts_a_file_once(spark, sf):
    """Whatever the number of its columns: 5 files, 15 columns."""
    assert _plan(plans.QUERIES["csv_inspection"](spark, sf)).count("TakeOrderedAndProject") == 5


@pytest.mark.parametrize("name", ["csv_files", "csv_inspection"])
def test_event_types_of_any_kind(spark, tmp_path, name):
    kinds = "array(null, '', 'a/b: c=%', 'view')"
    x = spark.range(400).selectExpr("id as event_id", "timestamp_seconds(1704067200 + id * 977) as ts", f"element_at({kinds}, int(id % 4 + 1)) as event_type", "id * id % 97 * 0.25D as value")
    x.withColumn("ts", x.ts.cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = plans.QUERIES[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(got) == rows(con.execute(plans.SQL[name]).fetch_df())


def test_sign_test_beyond_a_thousand(spark):
    x = spark.createDataFrame([(0, 0), (5, 8), (630, 1200), (20_000, 40_000)], "w long, n long")
    got = {r["n"]: r["p_value"] for r in metrics.sign_test(x, "w", "n").collect()}
    want = {8: 93 / 256} | {n: sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(w, n + 1)) for w, n in ((630, 1200), (20_000, 40_000))}
    assert got[0] == 1 and all(got[n] == pytest.approx(p, abs=1e-9) for n, p in want.items())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weighted_fill_has_no_frame_that_is_summed_anew(spark, sf):
    n = 2_000
    x = spark.range(n).selectExpr("0 as feeder_id", "id as device_id", "double(id % 37) as demand_kw", "1.5 as floor_kw", "double(1 + id % 3) as weight", "double(20000) as cap_kw")
    out = control.weighted_fill(x.withColumn("floor_kw", x.floor_kw.cast("double")), ["feeder_id"], digits=None)
    assert "currentrow$(), unboundedfollowing" not in _plan(out).lower()
    got = out.toPandas()
    assert got["limit_kw"].sum() == pytest.approx(20000) and got["feasible"].all()
    want = got.apply(lambda r: max(min(r.floor_kw, r.demand_kw), min(r.demand_kw, r.demand_kw - r.weight * r.pressure)), axis=1)
    assert (got["limit_kw"] - want).abs().max() < 1e-9


def test_pool_dispatch_has_no_frame_that_is_summed_anew(spark, sf):
    assert "currentrow$(), unboundedfollowing" not in _plan(plans.QUERIES["pool_dispatch"](spark, sf)).lower()


@pytest.mark.parametrize("name", ["water_fill", "water_fill_weighted", "pool_dispatch"])
def test_demands_half_way_between_hundredths(spark, tmp_path, name):
    x = spark.range(2_000).selectExpr("id as c_custkey", "int(id % 3) as c_nationkey", "id * 5 - 997.5D as c_acctbal")
    x.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = plans.QUERIES[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert rows(got) == rows(con.execute(plans.SQL[name]).fetch_df())


@pytest.fixture
def unsent(spark):
    """No table is small enough to be sent to all tasks."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["psi", "drift_status", "cvar"])
def test_no_task_takes_the_rows_of_a_group(spark, sf, unsent, name):
    """Three groups, so rows dealt by the group alone would meet in three tasks."""
    raw = {"psi": "recent", "drift_status": "recent", "cvar": r"CASE WHEN .* END AS c"}[name]
    assert not re.search(rf"Exchange hashpartitioning\(grp#\d+, \d+\).*\n[^\n]*Project \[grp#\d+, {raw}#", _plan(plans.QUERIES[name](spark, sf)))
    same_as_sql(spark, sf, name)


@pytest.fixture
def made_anew(spark):
    """What two branches need is made for each: a plan is no promise that exchanges are shared."""
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def test_values_that_all_differ_share_their_borders_with_the_totals(spark, made_anew):
    """Approximate quantiles go by the order of the rows and of the tasks that are merged, so borders made twice differ; here rows come at random."""
    x = spark.range(0, 600_000, 1, 2).selectExpr("id % 2 as grp", "double(id) as v", "1 as k")
    x = x.mapInPandas(lambda batches: [pd.concat(batches).sample(frac=1)], x.schema)
    out = metrics.cumulative(x, ["grp"], "v", ["k"])
    assert out.where("upto_k <> floor(v / 2) + 1 or all_k <> 300000").count() == 0 and out.count() == 600_000


def test_values_that_all_differ_are_not_dealt_by_the_group(spark, unsent):
    x = spark.range(1_000).selectExpr("id % 2 as grp", "double(id) as v", "1 as k")
    dealt = re.findall(r"Exchange hashpartitioning\(grp#\d+L?, \d+\).*\n\W*(\w+)", _plan(metrics.cumulative(x, ["grp"], "v", ["k"])))
    assert dealt and set(dealt) == {"HashAggregate", "Filter"}  # sums, shares and the borders that were read, no rows


def test_an_interval_has_three_blocks_at_most(spark):
    x = spark.range(1, 400).selectExpr("id as malo", "timestamp_seconds(1700000000 + id * 977) as start_ts", "timestamp_seconds(1700000000 + id * 977 + id * 1777) as end_ts", "double(id) as p_limit_kw")
    n = control._blocks(control._spans(x, "malo", 3600), "malo").groupBy("malo").count()
    assert n.count() == 399 and n.agg({"count": "max"}).first()[0] <= 3
    readings = x.selectExpr("malo", "explode(array(start_ts, end_ts, start_ts + (end_ts - start_ts) / 2, start_ts - interval 1 second, end_ts - interval 1 second)) as ts")
    got = control.active_limit(readings, x).join(x, "malo").collect()
    assert len(got) == 5 * 399 and all(r["active_limit_kw"] == (r["malo"] if r["start_ts"] <= r["ts"] < r["end_ts"] else None) for r in got)


def test_mint_tree_reads_its_tables_once_a_level(spark, sf):
    """The final plan joins what was written; the tables are no part of it any more."""
    plan = _plan(plans.QUERIES["mint_tree"](spark, sf))
    assert "orders.parquet" not in plan and "customer.parquet" not in plan and "o_totalprice" not in plan
