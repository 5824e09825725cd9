"""Wide columns <-> long records."""

import pytest
from pyspark.sql import functions as F
from support import BARS, SIX, near, random_bars

from tsquant.operators import indicators as I
from tsquant.operators import reshape as R


@pytest.fixture(scope="module")
def enriched(spark):
    rows = [("A", *row) for row in SIX]
    return I.enrich_all(spark.createDataFrame(rows, BARS)).cache()


def test_all_seven_are_found(enriched):
    assert R.indicator_columns(enriched) == [
        "SMA_20", "bollinger_upper", "bollinger_middle", "bollinger_lower", "RSI_14", "MACD",
        "MACD_Signal", "MACD_Histogram", "EMA_12", "Stochastic_%K_14", "Stochastic_%D_14_3", "OBV",
    ]


def test_names_are_classified(spark):
    names = {
        "SMA_20": ("SMA", "value"),
        "bollinger_lower": ("BOLLINGER", "lower"),
        "MACD": ("MACD", "line"),
        "MACD_Signal": ("MACD", "signal"),
        "MACD_Histogram": ("MACD", "histogram"),
        "Stochastic_%K_14": ("STOCHASTIC", "k"),
        "Stochastic_%D_14_3": ("STOCHASTIC", "d"),
        "EMA_12": ("EMA", "value"),
        "OBV": ("OBV", "value"),
        "something": ("OTHER", "value"),
    }
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = df.select("name", R.classify_indicator(F.col("name")), R.classify_value(F.col("name")))
    assert {r[0]: (r[1], r[2]) for r in rows.collect()} == names


def test_parameters(spark):
    kinds = ["SMA", "BOLLINGER", "RSI", "MACD", "OBV", "OTHER"]
    df = spark.createDataFrame([(k,) for k in kinds], "kind string")
    found = {r[0]: r[1] for r in df.select("kind", R.indicator_parameters(F.col("kind"))).collect()}
    assert found == {
        "SMA": {"period": 20.0},
        "BOLLINGER": {"period": 20.0, "stddev": 2.0},
        "RSI": {"period": 14.0},
        "MACD": {"fast": 12.0, "slow": 26.0, "signal": 9.0},
        "OBV": {},
        "OTHER": {},
    }


def test_unpivot(enriched):
    long = R.unpivot_indicators(enriched)
    assert long.columns == ["symbol", "timestamp", "indicator_name", "indicator_value"]
    assert long.count() == 6 * 12


def as_dict(records):
    rows = records.select("symbol", "timestamp", "indicator_type", "values").collect()
    found = {tuple(r[:3]): r["values"] for r in rows}
    assert len(found) == len(rows)
    return found


def test_records_are_the_same_with_and_without_a_shuffle(enriched):
    direct = as_dict(R.to_indicator_records(enriched))
    grouped = as_dict(R.group_indicator_maps(R.unpivot_indicators(enriched)))
    assert direct == grouped and len(direct) == 6 * 7
    last = max(direct)
    assert last[2] == "STOCHASTIC" and direct[last].keys() == {"k", "d"}


def test_record_row(enriched):
    record = R.to_indicator_records(enriched).where("indicator_type = 'MACD'").orderBy("timestamp").first()
    assert record["symbol"] == "A" and record["date_bucket"] == "2025-01"
    assert record["values"] == {"line": 0.0, "signal": 0.0, "histogram": 0.0}
    assert record["parameters"] == {"fast": 12.0, "slow": 26.0, "signal": 9.0}


def test_other_indicators(spark):
    chosen = [I.stddev_indicator(5), I.sma_indicator(7)]
    bars = spark.createDataFrame(random_bars({"A": 30}), BARS)
    records = R.to_indicator_records(I.enrich_all(bars, chosen), chosen)
    assert {r[0] for r in records.select("indicator_type").distinct().collect()} == {"STDDEV", "SMA"}
    kept = {tuple(r["parameters"].items()) for r in records.collect()}
    assert kept == {(("period", 5.0),), (("period", 7.0),)}
    with pytest.raises(ValueError, match="no indicator columns"):
        R.to_indicator_records(bars)


def test_wide_again(enriched):
    records = R.to_indicator_records(enriched)
    wide = R.read_indicator_value(records, [("BOLLINGER", "upper"), ("MACD", "signal"), ("SMA", "none")])
    assert wide.columns == ["symbol", "timestamp", "BOLLINGER_upper", "MACD_signal", "SMA_none"]
    expected = {r["timestamp"]: r for r in enriched.collect()}
    for row in wide.collect():
        assert near(row["BOLLINGER_upper"], expected[row["timestamp"]]["bollinger_upper"])
        assert near(row["MACD_signal"], expected[row["timestamp"]]["MACD_Signal"])
        assert row["SMA_none"] is None


def test_symbol_can_be_given(spark):
    df = spark.sql("SELECT timestamp'2025-03-04' AS timestamp")
    assert tuple(R.add_keys(df, "X").select("symbol", "date_bucket").first()) == ("X", "2025-03")
