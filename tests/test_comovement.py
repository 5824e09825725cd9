"""Co-moments kept as a table and advanced by days equal one run over all bars."""

import datetime as dt
import random

import pytest
from support import near

from tsquant.operators import risk as K
from tsquant.plans.comovement import CoMoments

SCHEMA = "symbol string, timestamp timestamp, close double"
START = dt.datetime(2025, 1, 1)


def daily(days, symbols="ABC", seed=3):
    """Two bars a day; C is missing now and then and stops early."""
    rng = random.Random(seed)
    level = {s: 100.0 * (10 ** (4 * i)) for i, s in enumerate(symbols)}
    rows = []
    for day in range(days):
        shock = rng.gauss(0, 0.01)
        for s in symbols:
            if s == "C" and (day % 5 == 2 or day > days - 4):
                continue
            for hour in (10, 16):
                level[s] *= 1 + shock * rng.random() + rng.gauss(0, 0.005)
                rows.append((s, START + dt.timedelta(days=day, hours=hour), level[s]))
    return rows


def of(rows, spark):
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return {(r["period"], r["symbol_a"], r["symbol_b"]): r for r in df.collect()}


def same(found, expected, tolerance=1e-12):
    assert found.keys() == expected.keys()
    for key, r in expected.items():
        assert found[key]["n"] == r["n"] and near(found[key]["correlation"], r["correlation"], tolerance), key


@pytest.mark.parametrize("value", ["simple_return", "log_return"])
def test_daily_updates_equal_one_run(spark, tmp_path, value):
    rows = daily(40)
    kept = CoMoments(spark, str(tmp_path / "c"), value=value)
    cuts = [START + dt.timedelta(days=d) for d in (0, 37, 38, 39, 40)]
    for first, end in zip(cuts, cuts[1:]):
        # Old bars are not given again, so they are unread.
        kept.advance(of([r for r in rows if first <= r[1] < end], spark))
        known = [r for r in rows if r[1] < end]
    same(pairs(kept.correlations()), pairs(K.correlation_matrix(of(known, spark), value=value)))


def test_an_interval_met_in_parts_and_a_load_that_comes_twice(spark, tmp_path):
    rows = daily(16)
    kept = CoMoments(spark, str(tmp_path / "c"))
    noon = START + dt.timedelta(days=12, hours=12)
    one, two = [r for r in rows if r[1] < noon], [r for r in rows if r[1] >= noon]
    assert kept.advance(of(one, spark)) == 1
    assert kept.advance(of(one, spark)) == 1  # nothing new, nothing written
    same(pairs(kept.correlations()), pairs(K.correlation_matrix(of(one, spark))))
    assert kept.advance(of(two, spark)) == 2
    assert kept.advance(of(rows, spark)) == 2
    same(pairs(kept.correlations()), pairs(K.correlation_matrix(of(rows, spark))))
    whole = K.covariance_matrix(K.returns(K.bars_by_period(of(rows, spark), ["day"])))
    found = {(r["symbol_a"], r["symbol_b"]): r for r in kept.covariances().collect()}
    for r in whole.collect():
        mine = found[r["symbol_a"], r["symbol_b"]]
        assert mine["n"] == r["n"] and all(near(mine[c], r[c], 1e-12) for c in ("mean_a", "mean_b", "covariance"))


def test_bars_of_ended_intervals_are_left_out(spark, tmp_path):
    rows = daily(6, "AB")
    kept = CoMoments(spark, str(tmp_path / "c"), periods=["day"])
    kept.advance(of(rows, spark))
    before = pairs(kept.correlations())
    kept.advance(of([("A", START + dt.timedelta(days=2, hours=20), 1e9), ("Z", START, 1.0)], spark))
    assert {k: tuple(r) for k, r in pairs(kept.correlations()).items()} == {k: tuple(r) for k, r in before.items()}


def test_a_run_that_fails_leaves_the_generation_before_it(spark, tmp_path):
    rows = daily(10, "AB")
    path = tmp_path / "c"
    kept = CoMoments(spark, str(path), periods=["day"])
    kept.advance(of(rows[:20], spark))
    kept.advance(of(rows[20:], spark))
    expected = pairs(kept.correlations())
    (path / "2" / "prices" / "_SUCCESS").unlink()  # lost before it was done
    again = CoMoments(spark, str(path), periods=["day"])
    assert again.generation() == 1 and again.advance(of(rows[20:], spark)) == 2
    same(pairs(again.correlations()), expected, 0)


def test_nothing_taken_in(spark, tmp_path):
    kept = CoMoments(spark, str(tmp_path / "c"))
    assert kept.advance(of([], spark)) == 0 and kept.advance(of([("A", START, None)], spark)) == 0
    assert kept.correlations(1).collect() == []
    kept.advance(of([("A", START, 0.0), ("B", START, 1.0), ("A", START + dt.timedelta(days=1), 1.0)], spark))
    assert kept.correlations().collect() == []


def test_merged_moments_keep_their_digits(spark):
    """Means of 10^9 with differences of 10^-3: raw squares would lose them."""
    rng = random.Random(1)
    xs, ys = ([1e9 + rng.gauss(0, 1e-3) for _ in range(30)] for _ in range(2))

    def moments(a, b):
        n, ma, mb = len(a), sum(a) / len(a), sum(b) / len(b)
        return ("day", "A", "B", n, ma, mb, sum((x - ma) ** 2 for x in a), sum((y - mb) ** 2 for y in b), sum((x - ma) * (y - mb) for x, y in zip(a, b)))

    parts = [moments(xs[i : i + 10], ys[i : i + 10]) for i in (0, 10, 20)]
    found = K.merge_moments(spark.createDataFrame(parts, K.MOMENT_SCHEMA)).first()
    assert found["n"] == 30 and all(near(found[c], v, 1e-3) for c, v in zip(("square_a", "square_b"), moments(xs, ys)[6:8]))
