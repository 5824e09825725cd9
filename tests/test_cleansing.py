"""Payload validation and cleansing."""

import json
import logging

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tsquant.operators import cleansing as V
from tsquant.schemas import BARS_TABLE, CORRUPT
from tsquant.sources.payloads import parse_chart_payloads



def payload(times, symbol="ACME", close=None, volume=None):
    """A chart payload with one bar per time."""
    n = len(times)
    quote = {
        "open": [10.0 + i for i in range(n)],
        "close": close or [11.0 + i for i in range(n)],
        "high": [12.0 + i for i in range(n)],
        "low": [9.0 + i for i in range(n)],
        "volume": [100 * (i + 1) for i in range(n)] if volume is None else volume,
    }
    meta = {"currency": "USD", "regularMarketPrice": 11.5, "dataGranularity": "1h"}
    if symbol:
        meta["symbol"] = symbol
    result = {"meta": meta, "timestamp": times, "indicators": {"quote": [quote]}}
    return json.dumps({"chart": {"result": [result], "error": None}})


AT = 1735732800  # 2025-01-01 12:00
GOOD = payload([AT])
BROKEN = '{"chart": {"result": [oops]'
EMPTY = json.dumps({"chart": {"result": [], "error": None}})
UNNAMED = payload([AT], symbol=None)
SHORT = payload([AT], volume=[])
TWO = payload([AT, AT + 3600], close=[11.0, None])


def landed(spark, *texts):
    rows = [("WANTED", t) for t in texts]
    return parse_chart_payloads(spark.createDataFrame(rows, "requested_symbol string, payload string"))


def test_nested_paths_resolve(spark):
    df = landed(spark, GOOD)
    assert V.require_paths(df).count() == 1
    assert V.require_paths(df, ["chart", "chart.result[0].meta", "chart.result[0].timestamp"]) is df
    with pytest.raises(ValueError, match="path not found: chart.nothing"):
        V.require_paths(df, ["chart.nothing"])
    with pytest.raises(ValueError, match="path not found: open"):
        V.require_paths(df, ["open"])


def test_has_columns(spark):
    df = landed(spark, GOOD)
    assert V.has_columns(df, ["chart", CORRUPT]) and not V.has_columns(df, ["chart", "open"])


def test_corrupt_rows_are_counted_and_dropped(spark, caplog):
    df = landed(spark, GOOD, BROKEN, GOOD, GOOD)
    assert tuple(V.corrupt_report(df).first()) == (1, 4, 25.0)
    with caplog.at_level(logging.WARNING):
        assert V.drop_corrupt(df, check=True).count() == 3
    assert "1/4 (25.00%)" in caplog.text and "oops" in caplog.text
    assert V.drop_corrupt(df.drop(CORRUPT)).count() == 4


def test_nothing_but_corrupt_rows_is_an_error(spark):
    with pytest.raises(ValueError, match="every record is corrupt"):
        V.drop_corrupt(landed(spark, BROKEN, BROKEN), check=True)
    assert tuple(V.corrupt_report(landed(spark, BROKEN).limit(0)).first()) == (0, 0, 0.0)


def test_extract(spark):
    df = V.extract_chart(landed(spark, GOOD, UNNAMED, EMPTY), F.col("requested_symbol"))
    assert df.columns == ["company_symbol", "timestamps", "opens", "closes", "highs", "lows", "volumes"]
    rows = df.collect()
    assert [r["company_symbol"] for r in rows] == ["ACME", "WANTED", "WANTED"]
    assert rows[0]["timestamps"] == [AT] and rows[0]["volumes"] == [100]
    assert rows[2]["timestamps"] is None
    quoted = V.extract_chart(landed(spark, UNNAMED), "O'X")
    assert quoted.first()["company_symbol"] == "O'X"
    assert V.extract_chart(landed(spark, UNNAMED)).first()["company_symbol"] is None


def test_arrays_must_be_aligned(spark):
    df = V.extract_chart(landed(spark, GOOD, SHORT, EMPTY, TWO))
    assert [len(r["opens"]) for r in V.keep_aligned_arrays(df).collect()] == [1, 2]


def test_requirements(spark):
    df = V.extract_chart(landed(spark, EMPTY))
    with pytest.raises(ValueError, match="no timestamps found for X"):
        V.require_timestamps(df, "for X")
    with pytest.raises(ValueError, match="no valid rows left"):
        V.require_non_empty(df.limit(0))
    good = V.extract_chart(landed(spark, GOOD))
    assert V.require_timestamps(good) is good and V.require_non_empty(good) is good
    volumes = spark.createDataFrame([(1,), (0,)], "volume bigint")
    assert V.require_non_negative_volume(volumes) is volumes
    with pytest.raises(ValueError, match="negative"):
        V.require_non_negative_volume(spark.createDataFrame([(-1,)], "volume bigint"))


def test_bars_of_payloads(spark):
    df = V.clean_bars(landed(spark, GOOD, BROKEN, EMPTY, SHORT, TWO, UNNAMED, GOOD), F.col("requested_symbol"))
    rows = sorted(df.collect())
    assert df.columns == BARS_TABLE.fieldNames()
    assert [(r["symbol"], r["date_bucket"], r["volume"]) for r in rows] == [
        ("ACME", "2025-01", 100),
        ("WANTED", "2025-01", 100),
    ]
    assert rows[0]["timestamp"].strftime("%Y-%m-%d %H:%M") == "2025-01-01 12:00"


def test_counts_come_with_the_result(spark):
    counts = Observation()
    bars = V.clean_bars(landed(spark, GOOD, BROKEN, EMPTY), "S", counts)
    assert len(bars.collect()) == 1
    assert counts.get == {"payloads": 3, "corrupt": 1, "timed": 1}
    V.check_load(counts.get, True)
    for given, reason in (
        ({"payloads": 2, "corrupt": 2, "timed": 0}, "every record is corrupt"),
        ({"payloads": 2, "corrupt": 1, "timed": 0}, "no timestamps found"),
        ({"payloads": 2, "corrupt": 1, "timed": 1}, "no valid rows left"),
        ({"payloads": 0, "corrupt": 0, "timed": 0}, "no timestamps found"),
    ):
        with pytest.raises(ValueError, match=reason):
            V.check_load(given, False)


def test_duplicates_leave_one_row_always_the_same(spark):
    rows = [("A", 1, 5.0, None), ("A", 1, 7.0, "x"), ("A", 1, 7.0, "y"), ("B", 1, 1.0, None)]
    schema = "symbol string, timestamp int, close double, note string"
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schema).repartition(3)
        assert sorted(map(tuple, V.dedup_bars(df).collect())) == [("A", 1, 7.0, "y"), ("B", 1, 1.0, None)]
        cheap = V.dedup_bars(df, prefer=[F.asc("close")])
        assert sorted(map(tuple, cheap.collect()))[0] == ("A", 1, 5.0, None)


def test_many_copies_of_one_row(spark):
    copies = spark.range(50_000).selectExpr("'A' AS symbol", "timestamp'2025-01-01' AS timestamp", "id AS volume")
    assert V.dedup_bars(copies).collect()[0]["volume"] == 49_999


def test_null_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    assert V.drop_null_rows(df, ["a", "b"]).count() == 1 and V.drop_null_rows(df, ["a"]).count() == 2


def test_payloads_are_parsed_once(spark):
    from support import plan_of

    bars = V.clean_bars(landed(spark, GOOD), F.col("requested_symbol"))
    assert plan_of(bars, "simple").count("from_json(") == 1
