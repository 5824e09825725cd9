"""Tail risk of windows of months from the stored table, and how little of it is read."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import near, plan_of

from tsquant.operators import risk as K
from tsquant.plans import risk_table
from tsquant.plans.risk_table import RiskTable

SCHEMA = "symbol string, timestamp timestamp, simple_return double"
START = dt.datetime(2025, 1, 1)


def returns(spark, counts, seed=5, days=150):
    rng = random.Random(seed)
    rows = [
        (s, START + dt.timedelta(days=days * i / n), round(rng.gauss(0, 0.01), 6 if s != "TIES" else 2))
        for s, n in counts.items()
        for i in range(n)
    ]
    return spark.createDataFrame(rows + [("A", START, None), (None, START, 0.5), ("A", START, float("nan"))], SCHEMA)


def same(found, expected):
    a, b = ({r["symbol"]: r for r in df.collect()} for df in (found, expected))
    assert a.keys() == b.keys()
    for symbol, r in b.items():
        assert a[symbol]["n"] == r["n"]
        assert all(near(a[symbol][c], r[c], 1e-12) for c in ("value_at_risk", "expected_shortfall"))


@pytest.fixture(scope="module")
def change(spark):
    return returns(spark, {"A": 30_000, "B": 900, "TIES": 5000, "ONE": 1, "TWO": 2}).cache()


def plain(change, first, last):
    month = F.date_format("timestamp", "yyyy-MM")
    rows = change.where("symbol IS NOT NULL AND simple_return IS NOT NULL AND NOT isnan(simple_return)")
    return rows.where(month.between(first, last))


def test_any_window_of_months_is_exact(spark, tmp_path, change):
    kept = RiskTable(spark, str(tmp_path / "r"))
    early = F.col("timestamp") < "2025-03-10"
    kept.advance(change.where(early))
    kept.advance(change.where(~early))
    assert kept.advance(change.where(~early)) == {"added": 0, "replaced": 0}
    for first, last in (("2025-01", "2025-05"), ("2025-02", "2025-03"), ("2025-05", "2025-05")):
        for confidence in (0.95, 0.999, 0.5):
            same(kept.var_es(first, last, confidence), K.historical_var_es(plain(change, first, last), confidence=confidence))
    assert kept.var_es("2031-01", "2031-02").collect() == []


def test_only_the_tail_is_read(spark, tmp_path, change):
    kept = RiskTable(spark, str(tmp_path / "r"))
    spark.conf.set("parquet.block.size", 64 * 1024)
    try:
        kept.advance(change.where("symbol = 'A'"))
    finally:
        spark.conf.unset("parquet.block.size")
    bounds = kept._pinned(kept.bounds("2025-01", "2025-05", 0.05))
    low, high = bounds.select("_low", "_high").first()
    values = np.array([r[0] for r in plain(change, "2025-01", "2025-05").where("symbol = 'A'").select("simple_return").collect()])
    inside = ((values >= low) & (values <= high)).mean()
    assert low < np.quantile(values, 0.05) < high and 0 < inside < 0.03
    tail = kept.tail("2025-01", "2025-05", bounds)
    pushed = next(x for x in plan_of(tail).splitlines() if "PushedFilters" in x)
    assert "LessThanOrEqual(value" in pushed
    assert tail.count() == (values <= high).sum()
    assert (values <= high).mean() < 0.08


def test_bounds_that_do_not_hold_are_widened(spark, tmp_path, change, monkeypatch):
    kept = RiskTable(spark, str(tmp_path / "r"))
    kept.advance(change)
    real, asked = RiskTable.bounds, []

    def narrow(self, first, last, p, widened=1):
        asked.append(widened)
        found = real(self, first, last, p, widened)
        return found if widened > 1 else found.withColumn("_high", F.col("_low")).withColumn("_low", F.col("_low") - 1e-9)

    monkeypatch.setattr(RiskTable, "bounds", narrow)
    same(kept.var_es("2025-01", "2025-05"), K.historical_var_es(plain(change, "2025-01", "2025-05")))
    assert asked == [1, 4]


def test_a_load_that_failed_before_its_sketches_is_mended_by_running_it_again(spark, tmp_path, change, monkeypatch):
    kept = RiskTable(spark, str(tmp_path / "r"))
    kept.advance(change.where("symbol = 'B'"))
    with monkeypatch.context() as m:
        m.setattr(risk_table, "replace_partitions", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.advance(change)
    assert kept.advance(change) == {"added": 0, "replaced": 0}
    same(kept.var_es("2025-01", "2025-05"), K.historical_var_es(plain(change, "2025-01", "2025-05")))


def test_nothing_taken_in(spark, tmp_path):
    kept = RiskTable(spark, str(tmp_path / "r"))
    assert kept.var_es("2025-01", "2025-02").collect() == []
    assert kept.advance(spark.createDataFrame([("A", START, None)], SCHEMA)) == {"added": 0, "replaced": 0}
