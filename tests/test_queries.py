"""Every registered query against its SQL, and the plans they get."""

import pytest
from compare import difference, duck_connection, duck_rows, spark_rows
from support import plan_of

from __spark_entry__ import entry, queries
from tsquant.functions.series import Series
from tsquant.operators import indicators as I
from tsquant.operators import latest as L
from tsquant.operators import reshape as R
from tsquant.plans import views
from tsquant.plans.oracles import ORACLES
from tsquant.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return duck_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, name):
    mine, theirs = spark_rows(spark, name, FOLDER), duck_rows(duck, name)
    assert difference(mine, theirs) is None
    assert mine[1]


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 868 and "SMA_20" in df.columns


def test_no_window_runs_in_a_single_task(spark):
    for name in ("enrich_all", "ema", "returns", "lag_features", "sentiment_evolution"):
        plan = plan_of(queries()[name](spark, FOLDER))
        assert "SinglePartition" not in plan and "Cartesian" not in plan, name
        assert "BroadcastNestedLoop" not in plan, name


def test_rows_are_exchanged_twice_and_sorted_twice(spark):
    """Once by slot, once by block; the rest belongs to the small slot table."""
    bars = spark.createDataFrame([], "symbol string, timestamp timestamp, open double, high double, low double, close double, volume bigint")
    chosen = [i for i in I.default_indicators() if i.family != "OBV"]
    plan = plan_of(I.enrich_all(bars, chosen, Series.of_bars("minute")), "simple")
    rows = [x for x in plan.splitlines() if "Exchange hashpartitioning(symbol" in x]
    assert len(rows) == 2 + 3
    assert plan.index("REPARTITION_BY_COL") > plan.index("windowspecdefinition")
    by_block = [x for x in plan.splitlines() if "Sort [symbol" in x and "_block" in x]
    assert len(by_block) == 1 and "_pos" in by_block[0]


def test_records_need_no_exchange(spark):
    bars = spark.range(1).selectExpr("'A' AS symbol", "current_timestamp() AS timestamp", "1.0D AS SMA_20", "2.0D AS RSI_14")
    assert "Exchange" not in plan_of(R.to_indicator_records(bars))


def test_newest_rows_are_cut_before_the_exchange(spark):
    bars = spark.createDataFrame([], "symbol string, timestamp timestamp, close double")
    for df in (L.latest_bars(bars, 5), L.latest_sma(bars, 20), L.latest_ema(bars, 26)):
        plan = plan_of(df, "simple")
        partial = next(x for x in plan.splitlines() if "WindowGroupLimit" in x and "Partial" in x)
        assert plan.index("Exchange hashpartitioning(symbol") < plan.index(partial.strip())
    assert "TakeOrderedAndProject" in plan_of(L.latest_bars(bars, 5, per_key=False), "simple")


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(views.bars_hourly(spark, FOLDER).select("symbol", "timestamp", "high"))
    schema = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "user_id" not in schema and "props" not in schema
