"""Values worked out by hand on six rows and its edge cases."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from support import SIX, START, near

from tsquant.operators import indicators as I
from tsquant.operators import latest as L
from tsquant.schemas import BAR
from tsquant.sources.payloads import bars_from_rows

GOLDEN = {
    "SMA_3": (lambda d: I.sma(d, 3), [20, 21, 21, 67 / 3, 68 / 3, 74 / 3]),
    "StdDev_3": (lambda d: I.rolling_stddev(d, 3), [None, 2**0.5, 1, (7 / 3) ** 0.5, (7 / 3) ** 0.5, (13 / 3) ** 0.5]),
    "bollinger_middle": (lambda d: I.bollinger(d, 3), [20, 21, 21, 67 / 3, 68 / 3, 74 / 3]),
    "bollinger_upper": (
        lambda d: I.bollinger(d, 3),
        [None, 23.828427125, 23, 25.388383797, 25.721717130, 28.829998666],
    ),
    "bollinger_lower": (
        lambda d: I.bollinger(d, 3),
        [None, 18.171572875, 19, 19.278282870, 19.611616203, 20.503334668],
    ),
    "EMA_3": (lambda d: I.ema(d, 3), [20, 21, 21, 22.5, 22.75, 24.875]),
    "EMA_12": (
        lambda d: I.ema_one_step(d, 12),
        [20, 20.307692308, 21, 21.461538462, 21.942307692, 22.769230769],
    ),
    "EMA_26": (
        lambda d: I.macd_one_step(d),
        [20, 20.148148148, 21, 21.222222222, 21.842592593, 22.370370370],
    ),
    "MACD": (lambda d: I.macd_one_step(d), [0, 0.159544160, 0, 0.239316239, 0.099715100, 0.398860399]),
    "MACD_Signal": (
        lambda d: I.macd_one_step(d),
        [0, 0.031908832, 0.063817664, 0.090408357, 0.099715100, 0.159544160],
    ),
    "MACD_Histogram": (
        lambda d: I.macd_one_step(d),
        [0, 0.127635328, -0.063817664, 0.148907882, 0, 0.239316239],
    ),
    "RSI_3": (lambda d: I.rsi(d, 3), [100, 100, 200 / 3, 250 / 3, 60, 87.5]),
    "Stochastic_%K_3": (lambda d: I.stochastic(d, 3, 3), [50, 75, 50, 80, 60, 1100 / 13]),
    "Stochastic_%D_3_3": (
        lambda d: I.stochastic(d, 3, 3),
        [50, 62.5, 58.333333333, 68.333333333, 63.333333333, 74.871794872],
    ),
    "OBV": (lambda d: I.obv(d), [0, 150, -270, -180, -440, 70]),
}


def column(df, name):
    return [row[name] for row in df.orderBy("timestamp").select(f"`{name}`").collect()]


@pytest.fixture(scope="module")
def six(spark):
    return bars_from_rows(spark, SIX).coalesce(1).cache()


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(six, name):
    operator, expected = GOLDEN[name]
    values = column(operator(six), name)
    assert len(values) == 6
    assert all(near(a, b, 1e-8) for a, b in zip(values, expected, strict=True)), values


def test_one_step_average_differs_from_recursive(six):
    assert column(I.ema_one_step(six, 3), "EMA_3")[4:] == pytest.approx([68 / 3, 149 / 6])


def test_two_step_volume(six):
    assert column(I.obv_two_step(six), "OBV") == [0, 150, -270, -330, -170, 250]


def test_smoothing_of_one_is_the_price(six):
    assert column(I.ema(six, 1), "EMA_1") == [20, 22, 21, 24, 23, 27]


def test_columns_of_the_frame_stay(six):
    found = I.sma(six.withColumnRenamed("open", "_open"), 3)
    assert found.columns == ["timestamp", "_open", "high", "low", "close", "volume", "SMA_3"]


def test_strict_windows_are_null_until_full(six):
    assert column(I.sma(six, 3, strict=True), "SMA_3") == pytest.approx([None, None, 21, 67 / 3, 68 / 3, 74 / 3])
    bands = I.bollinger(six, 3, strict=True)
    assert column(bands, "bollinger_upper")[:3] == [None, None, 23]


def test_population_deviation(six):
    values = column(I.rolling_stddev(six, 3, ddof=0), "StdDev_3")
    assert near(values[0], 0.0) and near(values[1], 1.0) and near(values[4], (14 / 9) ** 0.5)


def frame(spark, closes, volumes=None):
    volumes = volumes or [10] * len(closes)
    rows = [
        (START + dt.timedelta(minutes=i), c, c, c, c, v)
        for i, (c, v) in enumerate(zip(closes, volumes, strict=True))
    ]
    return bars_from_rows(spark, rows).coalesce(1)


def test_rsi_falling_and_mixed(spark):
    assert column(I.rsi(frame(spark, [10.0, 9.0, 8.0]), 3), "RSI_3") == [100, 0, 0]
    mixed = column(I.rsi(frame(spark, [10.0, 12.0, 11.0, 11.0]), 3), "RSI_3")
    assert near(mixed[2], 100 - 100 / (1 + 2.0 / 1.0)) and near(mixed[3], 100 - 100 / 3)


def test_flat_prices(spark):
    flat = frame(spark, [5.0, 5.0, 5.0])
    assert column(I.rsi(flat, 3), "RSI_3") == [100, 100, 100]
    assert column(I.stochastic(flat, 3, 3), "Stochastic_%K_3") == [50, 50, 50]
    assert column(I.obv(flat), "OBV") == [0, 0, 0]


def test_one_row(spark):
    one = I.enrich_all(frame(spark, [5.0])).first()
    assert one["SMA_20"] == 5.0 and one["bollinger_upper"] is None
    assert one["MACD"] == 0.0 and one["OBV"] == 0


def test_no_rows(spark):
    assert I.enrich_all(spark.createDataFrame([], BAR)).count() == 0


@pytest.mark.parametrize("operator", [I.obv, I.obv_two_step])
def test_negative_volume_fails(spark, operator):
    with pytest.raises(PySparkException, match="volume must not be negative"):
        operator(frame(spark, [1.0, 2.0], [5, -1])).collect()


def test_periods_are_checked(six):
    for call in (I.sma, I.rolling_stddev, I.bollinger, I.rsi, I.ema, I.ema_one_step):
        with pytest.raises(ValueError):
            call(six, 0)
    with pytest.raises(ValueError):
        I.ema(six, 3, smoothing=5.0)
    with pytest.raises(ValueError, match="missing columns: price"):
        I.sma(six, 3, "price")


def test_labels_and_parameters():
    labels = {i.label: i.settings for i in I.default_indicators()}
    assert list(labels) == [
        "SMA_20", "BOLLINGER_20", "RSI_14", "MACD", "EMA12", "StochasticOscillator", "OBV",
    ]
    assert labels["MACD"] == {
        "fastPeriod": 12,
        "slowPeriod": 26,
        "signalPeriod": 9,
        "smoothingFactor": 2.0,
        "priceColumn": "close",
    }
    assert I.stddev_indicator(5).label == "StdDev_5"
    assert labels["OBV"] == {"closeColumn": "close", "volumeColumn": "volume"}


def test_latest_values(spark, six):
    keyed = six.selectExpr("'A' AS symbol", "*").unionByName(
        frame(spark, [1.0, 2.0]).selectExpr("'B' AS symbol", "*")
    )
    means = {r["symbol"]: r["SMA_3"] for r in L.latest_sma(keyed, 3).collect()}
    assert means == {"A": pytest.approx(74 / 3), "B": None}
    with pytest.raises(PySparkException, match="fewer than 3 values"):
        L.latest_sma(keyed, 3, required=True).collect()
    averages = {r["symbol"]: r["EMA_3"] for r in L.latest_ema(keyed, 3).collect()}
    assert near(averages["A"], 24.875) and near(averages["B"], 1.5)
    newest = {r["symbol"]: r["close"] for r in L.latest_bars(keyed, 1).collect()}
    assert newest == {"A": 27, "B": 2}
    assert [r["close"] for r in L.latest_bars(six, 2).collect()] == [27, 23]


def test_latest_rows_beyond_the_rank_limit(spark, monkeypatch):
    """The same rows on both sides of the limit."""
    rows = [("A", START + dt.timedelta(minutes=i), float(i)) for i in range(50)] + [("B", START, 7.0)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, close double").repartition(4)
    cut = {(r.symbol, r.timestamp, r.close) for r in L.latest_bars(df, 20).collect()}
    mean = {tuple(r) for r in L.latest_sma(df, 20).collect()}
    average = {r.symbol: r.EMA_9 for r in L.latest_ema(df, 9).collect()}
    monkeypatch.setattr(L, "RANK_LIMIT", 10)
    assert {(r.symbol, r.timestamp, r.close) for r in L.latest_bars(df, 20).collect()} == cut
    assert {tuple(r) for r in L.latest_sma(df, 20).collect()} == mean
    assert all(near(average[r.symbol], r.EMA_9) for r in L.latest_ema(df, 9).collect())


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_averages_refuse_what_is_not_finite(spark, bad):
    rows = [("A", START + dt.timedelta(minutes=i), bad if i == 3 else float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, close double")
    for operator in (I.ema, I.macd, L.latest_ema):
        with pytest.raises(PySparkException, match="must be finite"):
            operator(df).collect()
