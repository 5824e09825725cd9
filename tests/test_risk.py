"""Quantiles, co-movement, scenarios, features."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from support import START, near, plan_of

from tsquant.operators import model as M
from tsquant.operators import risk as K
from tsquant.operators.quantile import exact_quantile


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(3)
    data = {
        "long": [rng.gauss(0, 1) for _ in range(60_000)],
        "ties": [float(rng.choice([0, 0, 0, 0, -1, 1, 2])) for _ in range(20_000)],
        "same": [4.5] * 5_000,
        "short": [rng.random() for _ in range(7)],
        "one": [2.0],
        "two": [1.0, 3.0],
    }
    rows = [(k, v) for k, values in data.items() for v in values] + [("one", None)]
    rng.shuffle(rows)
    return data, spark.createDataFrame(rows, "symbol string, x double").repartition(6).cache()


@pytest.mark.parametrize("p", [0.0, 0.01, 0.05, 0.333, 0.5, 0.95, 1.0])
def test_quantiles_are_exact(samples, p):
    data, df = samples
    found = {r["symbol"]: r for r in exact_quantile(df, "x", p).collect()}
    assert found.keys() == data.keys()
    for name, values in data.items():
        quantile = np.quantile(values, p)
        tail = [v for v in values if v <= quantile]
        assert found[name]["n"] == len(values)
        assert near(found[name]["quantile"], quantile, 1e-12), (name, p)
        assert found[name]["tail_n"] == len(tail)
        assert near(found[name]["tail_mean"], np.mean(tail), 1e-9)


@pytest.mark.parametrize("brackets", [((0, None), (50, 0.02), (400, 0.01)), ((0, None), (10, 0.2), (100, 0.05))])
def test_quantiles_with_other_brackets(samples, monkeypatch, brackets):
    monkeypatch.setattr("tsquant.operators.quantile.BRACKETS", brackets)
    data, df = samples
    found = {r["symbol"]: r["quantile"] for r in exact_quantile(df, "x", 0.05).collect()}
    assert all(near(found[n], np.quantile(v, 0.05), 1e-12) for n, v in data.items())


@pytest.mark.parametrize("hot", [1, 100, 30_000])
def test_quantiles_with_hot_keys(samples, monkeypatch, hot):
    monkeypatch.setattr("tsquant.functions.skew.HOT_ROWS", hot)
    data, df = samples
    found = {r["symbol"]: r["quantile"] for r in exact_quantile(df, "x", 0.05).collect()}
    assert found.keys() == data.keys()
    assert all(near(found[n], np.quantile(v, 0.05), 1e-12) for n, v in data.items())


def test_rows_of_a_hot_key_are_spread(samples):
    plan = plan_of(exact_quantile(samples[1], "x", 0.05), "simple")
    assert "hashpartitioning(symbol" in plan and "_piece" in plan
    joins = [x for x in plan.splitlines() if "Join [symbol" in x]
    assert any("BroadcastHashJoin" in j for j in joins) and any("_piece" in j for j in joins)
    counts = [x for x in plan.splitlines() if "partial_count" in x and "_groupingexpression" in x]
    assert counts, "counts per value must be combined before their exchange"


def test_value_at_risk(samples):
    data, df = samples
    row = K.historical_var_es(df, "x", 0.99).where("symbol = 'long'").first()
    limit = np.quantile(data["long"], 0.01)
    assert near(row["value_at_risk"], limit)
    assert near(row["expected_shortfall"], np.mean([v for v in data["long"] if v <= limit]))


@pytest.fixture(scope="module")
def moves(spark):
    rng = random.Random(5)
    rows = []
    for day in range(2500):
        common = rng.gauss(0, 0.01)
        for number in range(9):
            if rng.random() < 0.8:
                rows.append((f"S{number}", dt.datetime(2015, 1, 1) + dt.timedelta(days=day), common + rng.gauss(0, 0.02)))
        rows.append(("flat", dt.datetime(2015, 1, 1) + dt.timedelta(days=day), 0.1))
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, x double")
    return pd.DataFrame(rows, columns=["s", "t", "x"]).pivot(index="t", columns="s", values="x"), df


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_covariances_do_not_depend_on_the_blocks(moves, blocks):
    wide, df = moves
    found = K.covariance_matrix(df, "x", symbol_blocks=blocks).collect()
    expected = wide.cov()
    assert len(found) == 10 * 11 // 2
    for r in found:
        both = wide[[r["symbol_a"], r["symbol_b"]]].dropna()
        assert r["symbol_a"] <= r["symbol_b"] and r["n"] == len(both)
        assert abs(r["covariance"] - expected.loc[r["symbol_a"], r["symbol_b"]]) < 1e-12
        assert near(r["mean_a"], both.iloc[:, 0].mean(), 1e-9)


def test_slices_of_time_add_up(moves, monkeypatch):
    wide, df = moves
    monkeypatch.setattr(K, "SLICE_BARS", 40)
    found = {(r["symbol_a"], r["symbol_b"]): r for r in K.pair_moments(df, "x", symbol_blocks=3).collect()}
    expected = wide.corr()
    for (a, b), r in found.items():
        if a < b and "flat" not in (a, b):
            value = r["cross"] / (r["square_a"] * r["square_b"]) ** 0.5
            assert abs(value - expected.loc[a, b]) < 1e-9
    assert found["flat", "flat"]["square_a"] == 0.0


def test_correlation(spark):
    rng, rows = random.Random(1), []
    for symbol in "ABC":
        price = 100.0
        for day in range(120):
            price *= 1 + rng.gauss(0, 0.01)
            at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=3)
            rows.append((symbol, at, 1.0 if symbol == "C" else price))
    bars = spark.createDataFrame(rows, "symbol string, timestamp timestamp, close double")
    found = {(r["period"], r["symbol_a"], r["symbol_b"]): r for r in K.correlation_matrix(bars).collect()}
    assert len(found) == 9 and found["day", "A", "C"]["correlation"] is None
    wide = pd.DataFrame(rows, columns=["s", "t", "x"]).pivot(index="t", columns="s", values="x")
    daily = wide.pct_change().corr().loc["A", "B"]
    weekly = wide.groupby(wide.index.to_period("W")).last().pct_change().corr().loc["A", "B"]
    assert near(found["day", "A", "B"]["correlation"], daily) and found["day", "A", "B"]["n"] == 119
    assert near(found["week", "A", "B"]["correlation"], weekly)
    with pytest.raises(ValueError, match="not a period"):
        K.correlation_matrix(bars, ["hour"])


def test_blocks_are_counted(spark):
    df = spark.range(2000).selectExpr("cast(id as string) AS symbol")
    assert 7 <= K.count_symbol_blocks(df) <= 9 and K.count_symbol_blocks(df.limit(0)) == 1


def test_scenarios(spark):
    held = spark.createDataFrame([("P", "A", 10.0), ("P", "A", 5.0), ("P", "B", 1.0), ("Q", "C", 9.0)], "portfolio string, symbol string, amount double")
    shocks = spark.createDataFrame([("crash", "A", -0.5), ("crash", "B", 1.0), ("calm", "A", 0.1)], "scenario string, symbol string, shock double")
    found = {(r[0], r[1]): (r[2], r[3]) for r in K.scenario_impact(held, shocks).collect()}
    assert found == {
        ("P", "crash"): (-6.5, 16.0), ("P", "calm"): (1.5, 16.0), ("Q", "crash"): (0.0, 9.0), ("Q", "calm"): (0.0, 9.0),
    }


def test_forecast_errors(spark):
    rows = [("A", 10.0, 11.0), ("A", 20.0, 18.0), ("A", None, 1.0), ("B", 0.0, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, y double, p double")
    found = {r["symbol"]: r for r in M.forecast_metrics(df, "y", "p").collect()}
    assert near(found["A"]["rmse"], (5 / 2) ** 0.5) and near(found["A"]["mape"], 10.0) and found["A"]["n"] == 2
    assert found["B"]["mape"] is None and found["B"]["rmse"] == 3.0


def test_features_need_positive_lags(spark):
    df = spark.createDataFrame([("A", START, 1.0)], "symbol string, timestamp timestamp, close double")
    with pytest.raises(ValueError):
        M.lag_features(df, ["close"], (0,))
    row = M.lag_features(df, ["close"], (1,)).first()
    assert row["close_lag_1"] is None and row["next_close"] is None


def test_no_pairing_of_rows(moves):
    _, df = moves
    plan = plan_of(K.covariance_matrix(df, "x", symbol_blocks=2))
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    # Three joins, each with the table of one shift per symbol; rows never meet rows.
    joins = [x for x in plan_of(K.covariance_matrix(df, "x", symbol_blocks=2), "simple").splitlines() if "Join" in x]
    assert len(joins) == 3 and all("symbol" in x and " at#" not in x for x in joins)


def test_moments_at_a_high_level(spark):
    """A mean of 1e6 beside a deviation of 0.07 costs no digits; constants have none."""
    rng = random.Random(8)
    rows = []
    for day in range(1500):
        step = rng.gauss(0, 0.07)
        at = dt.datetime(2020, 1, 1) + dt.timedelta(days=day)
        rows += [("A", at, 1e6 + step), ("B", at, 1e6 + step / 2 + rng.gauss(0, 0.07)), ("C", at, 0.1)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, x double")
    found = {(r["symbol_a"], r["symbol_b"]): r for r in K.covariance_matrix(df, "x").collect()}
    wide = pd.DataFrame(rows, columns=["s", "t", "x"]).pivot(index="t", columns="s", values="x")
    exact = (wide - wide.iloc[0]).cov()
    for a, b in (("A", "A"), ("A", "B"), ("B", "B")):
        assert near(found[a, b]["covariance"], exact.loc[a, b], 1e-7)
        assert near(found[a, b]["mean_a"], wide[a].mean(), 1e-9)
    assert found["C", "C"]["covariance"] == 0.0 and found["A", "C"]["covariance"] == 0.0


def test_repeated_and_close_rows_are_refused(spark):
    at = dt.datetime(2020, 1, 1)
    twice = spark.createDataFrame([("A", at, 1.0), ("A", at, 2.0)], "symbol string, timestamp timestamp, x double")
    with pytest.raises(Exception, match="more than one row"):
        K.covariance_matrix(twice, "x").collect()
    close = spark.range(3000).selectExpr("'A' AS symbol", "timestamp_seconds(id) AS timestamp", "rand(1) AS x")
    with pytest.raises(Exception, match="closer than their interval"):
        K.covariance_matrix(close, "x").collect()
    gaps = spark.createDataFrame([("A", at, float("nan")), ("A", at + dt.timedelta(1), 1.0), ("A", at + dt.timedelta(2), 2.0)], "symbol string, timestamp timestamp, x double")
    assert K.covariance_matrix(gaps, "x").first()["n"] == 2
