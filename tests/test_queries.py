import pytest
from tests.compare import duck, rows

from loadweave import plans


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, sf, con, name):
    got = plans.QUERIES[name](spark, sf).toPandas()
    want = con.execute(plans.SQL[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["ridge_backtest", "bootstrap_skill", "thermal_risk", "cvar_nomination", "quantile_regression_forecast"])
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
