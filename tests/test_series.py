"""However a series is cut into slots and blocks, the values are those of one
plain pass over it."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F
from support import BARS, START, near, random_bars

from tsquant.functions.series import (
    POS,
    Series,
    Slots,
    in_blocks,
    interval_micros,
    measure_slots,
    number_rows,
    over_blocks,
    with_slots,
)
from tsquant.operators import indicators as I
from tsquant.operators import latest as L
from tsquant.operators import model as M
from tsquant.operators import news as N
from tsquant.operators import risk as K

SYMBOLS = {"HOT": 1500, "MID": 400, "ONE": 1, "TWO": 2}
CUTS = [
    Series(),
    Series(slot_micros=600_000_000, block_rows=64),
    Series(slot_micros=86_400_000_000, block_rows=7),
    Series(slot_micros=1, block_rows=100),
]


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(random_bars(SYMBOLS), BARS).coalesce(2).cache()


def by_row(df, *columns):
    rows = df.select("symbol", "timestamp", *[F.col(f"`{c}`") for c in columns]).collect()
    found = {(r[0], r[1]): tuple(r[2:]) for r in rows}
    assert len(found) == len(rows)
    return found


def assert_same(a, b, tolerance=1e-9):
    assert a.keys() == b.keys()
    for key, values in a.items():
        for x, y in zip(values, b[key], strict=True):
            assert near(x, y, tolerance), (key, values, b[key])


def in_order(rows):
    series = {}
    for row in sorted(rows, key=lambda r: r["timestamp"]):
        series.setdefault(row["symbol"], []).append(row)
    return series


@pytest.mark.parametrize("cut", CUTS)
def test_positions(bars, cut):
    plain = F.row_number().over(Window.partitionBy("symbol").orderBy("timestamp")) - 1
    expected = by_row(bars.withColumn("p", plain), "p")
    assert by_row(number_rows(bars, cut), POS) == expected


@pytest.mark.parametrize("cut", CUTS[1:])
def test_all_indicators_do_not_depend_on_the_cut(bars, cut):
    names = [c for i in I.default_indicators() for c in i.outputs.values()]
    names += ["EMA_26"]
    whole = by_row(I.enrich_all(bars, series=CUTS[0]), *names)
    assert_same(by_row(I.enrich_all(bars, series=cut), *names), whole)


@pytest.mark.parametrize("cut", CUTS)
def test_plain_windows(bars, cut):
    window = Window.partitionBy("symbol").orderBy("timestamp")
    frame = window.rowsBetween(-19, 0)
    change = F.col("close") - F.lag("close").over(window)
    expected = by_row(
        bars.withColumn("mean", F.avg("close").over(frame))
        .withColumn("spread", F.stddev_samp("close").over(frame))
        .withColumn("signed", F.when(change > 0, F.col("volume")).when(change < 0, -F.col("volume")).otherwise(0))
        .withColumn("obv", F.sum("signed").over(window)),
        "mean", "spread", "obv",
    )
    found = I.add_indicators(bars, [I.stddev_indicator(20), I.obv_indicator()], cut)
    assert_same(by_row(found, "SMA_20", "StdDev_20", "OBV"), expected)


@pytest.mark.parametrize("cut, period", [(CUTS[0], 12), (CUTS[1], 2), (CUTS[1], 200), (CUTS[2], 12)])
def test_ema_is_the_recurrence(bars, cut, period):
    weight, expected = 2.0 / (1 + period), {}
    for symbol, rows in in_order(bars.collect()).items():
        ema = None
        for row in rows:
            ema = row["close"] if ema is None else weight * row["close"] + (1 - weight) * ema
            expected[symbol, row["timestamp"]] = (ema,)
    assert_same(by_row(I.ema(bars, period, series=cut), f"EMA_{period}"), expected, 1e-12)


def test_averages_of_very_different_length_together(bars):
    cut = CUTS[1]
    both = I.add_indicators(bars, [I.ema_indicator(2), I.ema_indicator(300)], cut)
    for period in (2, 300):
        alone = I.ema(bars, period, series=Series())
        name = f"EMA_{period}"
        assert_same(by_row(both, name), by_row(alone, name), 1e-12)


@pytest.mark.parametrize("cut", CUTS[1:3])
def test_macd_is_the_recurrence(bars, cut):
    expected = {}
    for symbol, rows in in_order(bars.collect()).items():
        fast = slow = signal = None
        for row in rows:
            x = row["close"]
            fast = x if fast is None else fast + (x - fast) * 2 / 13
            slow = x if slow is None else slow + (x - slow) * 2 / 27
            line = fast - slow
            signal = line if signal is None else signal + (line - signal) * 0.2
            expected[symbol, row["timestamp"]] = (line, signal)
    assert_same(by_row(I.macd(bars, series=cut), "MACD", "MACD_Signal"), expected)


def test_symbols_do_not_touch(bars):
    whole = by_row(I.enrich_all(bars), "SMA_20", "RSI_14", "MACD", "OBV")
    alone = {}
    for symbol in SYMBOLS:
        alone |= by_row(
            I.enrich_all(bars.where(F.col("symbol") == symbol)), "SMA_20", "RSI_14", "MACD", "OBV"
        )
    assert_same(whole, alone)


def test_months_can_start_anew(spark):
    rows = [("A", dt.datetime(2025, m, d), *[float(m * 10 + d)] * 4, 1) for m in (1, 2) for d in (1, 2)]
    bars = spark.createDataFrame(rows, BARS).withColumn("date_bucket", F.date_format("timestamp", "yyyy-MM"))
    anew = I.sma(bars, 3, series=Series(keys=("symbol", "date_bucket")))
    through = I.sma(bars, 3)
    assert [r["SMA_3"] for r in anew.orderBy("timestamp").collect()] == [11, 11.5, 21, 21.5]
    assert [r["SMA_3"] for r in through.orderBy("timestamp").collect()][2] == (11 + 12 + 21) / 3


def test_ties_follow_the_tiebreak(spark):
    rows = [("A", START, i, float(i)) for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, id int, price double")
    found = I.sma(df, 2, "price", series=Series(tiebreak=("id",)))
    assert {r["id"]: r["SMA_2"] for r in found.collect()} == {1: 1.0, 2: 1.5, 3: 2.5}


def test_one_series_without_a_key(bars):
    alone = bars.where("symbol = 'MID'")
    unkeyed = I.sma(alone.drop("symbol"), 20, series=Series(keys=(), slot_micros=10**9, block_rows=32))
    expected = {r["timestamp"]: r["SMA_20"] for r in I.sma(alone, 20).collect()}
    assert {r["timestamp"]: r["SMA_20"] for r in unkeyed.collect()} == expected


@pytest.mark.parametrize("row", [(None, START, 1.0), ("A", None, 1.0)])
def test_rows_without_key_or_time_are_refused(spark, row):
    df = spark.createDataFrame([row], "symbol string, timestamp timestamp, close double")
    with pytest.raises(PySparkException, match="must not be null"):
        I.sma(df, 3, series=Series.of_bars("minute")).collect()


def test_copies_stay_few(bars):
    series = Series(slot_micros=10**9, block_rows=64)
    blocked, size = in_blocks(number_rows(bars, series), series, lookback=13)
    assert size >= 64 and size >= 8 * 13
    assert blocked.count() <= bars.count() * (1 + 13 / size) + 13 * len(SYMBOLS)


def test_numbered_rows_are_not_counted_again(bars):
    from support import plan_of

    cut = CUTS[1]
    numbered = number_rows(bars, cut)
    chained = M.lag_features(I.rsi(I.sma(numbered, 5, series=cut), 9, series=cut), ["SMA_5", "RSI_9"], (2,), series=cut)
    assert chained.columns[len(bars.columns)] == POS
    apart = M.lag_features(I.rsi(I.sma(bars, 5, series=cut), 9, series=cut), ["SMA_5", "RSI_9"], (2,), series=cut)
    names = ("SMA_5", "RSI_9", "SMA_5_lag_2", "RSI_9_lag_2", "next_close")
    assert_same(by_row(chained, *names), by_row(apart, *names))
    assert plan_of(chained, "simple").count("row_number()") == 1
    assert by_row(I.obv(numbered, series=cut), "OBV") == by_row(I.obv(bars, series=cut), "OBV")


def test_times_before_1970(spark):
    rows = [("A", dt.datetime(1969, 12, 31) + dt.timedelta(hours=i), float(i)) for i in range(48)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, close double")
    found = number_rows(df, Series(slot_micros=5 * 3_600_000_000))
    assert [r[POS] for r in found.orderBy("timestamp").collect()] == list(range(48))


def test_slots_follow_the_data(spark):
    rows = [("A", START + dt.timedelta(seconds=6 * i)) for i in range(1200)] + [("B", START)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp")
    assert measure_slots(df, Series(), rows=100) == Slots(1, 6)
    assert measure_slots(df, Series(), rows=3000) == Slots(5, 1)
    assert measure_slots(df.limit(0), Series(), rows=60) == Slots(60, 1)


@pytest.fixture(scope="module")
def burst(spark):
    """A third of a symbol within one second, the rest one row in ten minutes."""
    second = [("A", START + dt.timedelta(microseconds=1500 * i), float(i % 37)) for i in range(600)]
    slow = [("A", START + dt.timedelta(minutes=10 * i - 7000), float(i % 41)) for i in range(1200)]
    slow += [("B", START + dt.timedelta(hours=i), float(i)) for i in range(90)]
    rows = list({(s, t): (s, t, c) for s, t, c in second + slow}.values())
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp, close double").coalesce(2).cache()


@pytest.mark.parametrize("rows", [20, 100])
def test_a_burst_is_cut_finer(burst, rows):
    slots = measure_slots(burst, Series(), rows=rows)
    assert len(slots.hot) == 1 and slots.hot[0][1] == -(-605 // rows)
    cut = Series(slots=Slots(slots.hours, slots.parts, ((slots.hot[0][0], 1 << 20),)), block_rows=50)
    for series in (Series(slots=slots, block_rows=50), cut):
        slotted, _ = with_slots(burst, series)
        by_time = slotted.orderBy("symbol", "timestamp").collect()
        for a, b in zip(by_time, by_time[1:], strict=False):
            assert a["symbol"] != b["symbol"] or a["_slot"] <= b["_slot"]
        whole = Series(slot_micros=10**16, block_rows=10**6)
        assert by_row(number_rows(burst, series), POS) == by_row(number_rows(burst, whole), POS)
        for seconds in (3600, 5000):
            assert by_row(N.value_before(burst, "close", seconds, "ago", series), "ago") == by_row(
                N.value_before(burst, "close", seconds, "ago", whole), "ago"
            )
    sizes = with_slots(burst, cut)[0].groupBy("symbol", "_slot").count().agg(F.max("count")).first()[0]
    assert sizes <= max(60, rows)


def test_hours_beside_a_hot_one_keep_their_order():
    slots = Slots(hours=4, parts=1, hot=((5, 9), (-3, 2)))
    assert slots.cut_hours() == {4: 1, 5: 9, 6: 1, 7: 1, -4: 1, -3: 2, -2: 1, -1: 1}
    assert dict(Slots(1, 1, ((5, 9),)).also_before(5400).hot) == {5: 9, 4: 9, 3: 9}


def test_intervals():
    assert interval_micros("15 minutes") == 900_000_000
    assert interval_micros("hour") == 3_600_000_000
    for wrong in ("month", "0 days", "x y z"):
        with pytest.raises(ValueError):
            interval_micros(wrong)


@pytest.mark.parametrize("cut", CUTS)
def test_lags_leads_and_returns(bars, cut):
    window = Window.partitionBy("symbol").orderBy("timestamp")
    expected = by_row(
        bars.withColumn("a", F.lag("close", 1).over(window))
        .withColumn("b", F.lag("close", 3).over(window))
        .withColumn("c", F.lead("close").over(window))
        .withColumn("r", F.col("close") / F.col("a") - 1),
        "a", "b", "c", "r",
    )
    found = M.lag_features(K.returns(bars, series=cut), ["close"], (1, 3), series=cut)
    names = ("close_lag_1", "close_lag_3", "next_close", "simple_return")
    assert_same(by_row(found, *names), expected)


@pytest.mark.parametrize("cut", CUTS)
def test_value_some_time_ago(spark, bars, cut):
    scored = bars.withColumn("close", F.when(F.col("volume") % 5 != 0, F.col("close")))
    found = by_row(N.value_before(scored, "close", 7200, "ago", cut), "ago")
    expected = {}
    for symbol, rows in in_order(scored.collect()).items():
        for row in rows:
            limit = row["timestamp"] - dt.timedelta(seconds=7200)
            old = [r["close"] for r in rows if r["timestamp"] <= limit and r["close"] is not None]
            expected[symbol, row["timestamp"]] = (old[-1] if old else None,)
    assert found == expected


@pytest.mark.parametrize("period", [3, 12, 150])
def test_latest_average_is_the_last_of_the_series(bars, period):
    name = f"EMA_{period}"
    newest = {}
    for (symbol, at), (value,) in sorted(by_row(I.ema(bars, period), name).items()):
        newest[symbol] = value
    found = {r["symbol"]: r[name] for r in L.latest_ema(bars, period).collect()}
    assert found.keys() == newest.keys()
    assert all(near(found[s], newest[s], 1e-12) for s in found)


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    gaps=st.lists(st.integers(1, 5000), min_size=1, max_size=60),
    slot=st.integers(1, 20_000),
    block=st.integers(1, 20),
    period=st.integers(1, 9),
)
def test_any_cut(spark, gaps, slot, block, period):
    at, rows = START, []
    for i, gap in enumerate(gaps):
        at += dt.timedelta(seconds=gap)
        rows.append(("A", at, float((i * 7919) % 101)))
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, close double")
    series = Series(slot_micros=slot * 1_000_000, block_rows=block)
    found = over_blocks(
        df, lambda f: [{"m": F.sum("close").over(f.last(period))}], series, lookback=period - 1
    )
    values = [r["m"] for r in found.orderBy("timestamp").collect()]
    closes = [r[2] for r in rows]
    assert values == [sum(closes[max(0, i - period + 1) : i + 1]) for i in range(len(closes))]
