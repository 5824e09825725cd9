"""Technical indicators over ordered price series.

Every indicator states its window formulas as levels (a level may use the columns
of the levels before it) and how many rows back they look. ``add_indicators``
lays the rows out once for any number of indicators and merges their levels, so
all of them share one sort and a handful of Window nodes.

Frames are partial at the start of a series: before ``n`` rows the average is over
the rows there are, unless ``strict`` asks for NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsquant.functions.decay import Decay, common_run, ema_levels, run_column, run_name
from tsquant.functions.scalars import (
    checked_volume,
    macd_line,
    rsi_from_averages,
    signed_volume,
    stochastic_k,
)
from tsquant.functions.series import (
    BEFORE,
    BLOCK,
    COUNT,
    POS,
    SLOT,
    Frames,
    Series,
    in_blocks,
    join_slots,
    number_rows,
    own_rows,
    position_in_slots,
    require_columns,
    rows_before,
    with_slots,
)

Level = dict[str, Column]


@dataclass(frozen=True)
class Indicator:
    """One configured indicator: its label, parameters, outputs and formulas."""

    label: str
    family: str
    settings: dict[str, object]  # as the indicator was configured
    stored: dict[str, float]  # parameter map of stored records
    outputs: dict[str, str]  # value type -> column
    inputs: tuple[str, ...]
    lookback: int
    levels: Callable[[Frames, dict], list[Level]]
    decays: tuple[Decay, ...] = ()
    cumulative: tuple[str, str] | None = None  # close, volume of a running OBV


def _positive(**periods: int) -> None:
    for name, value in periods.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def _mean(frames: Frames, column: str, period: int, strict: bool = False) -> Column:
    return _full(frames, column, period, strict, F.avg(column).over(frames.last(period)))


def _full(frames: Frames, column: str, period: int, strict: bool, value: Column) -> Column:
    if not strict:
        return value
    return F.when(F.count(column).over(frames.last(period)) >= period, value)


def _deviation(column: str, ddof: int) -> Column:
    if ddof not in (0, 1):
        raise ValueError("ddof must be 0 or 1")
    return F.stddev_samp(column) if ddof else F.stddev_pop(column)


def sma_indicator(period: int = 20, price: str = "close", strict: bool = False) -> Indicator:
    _positive(period=period)
    name = f"SMA_{period}"
    return Indicator(
        label=name,
        family="SMA",
        settings={"period": period, "priceColumn": price},
        stored={"period": float(period)},
        outputs={"value": name},
        inputs=(price,),
        lookback=period - 1,
        levels=lambda frames, runs: [{name: _mean(frames, price, period, strict)}],
    )


def stddev_indicator(
    period: int = 20, price: str = "close", ddof: int = 1, strict: bool = False
) -> Indicator:
    _positive(period=period)
    name, mean = f"StdDev_{period}", f"SMA_{period}"
    deviation = _deviation(price, ddof)

    def levels(frames: Frames, runs: dict) -> list[Level]:
        spread = deviation.over(frames.last(period))
        return [
            {
                mean: _mean(frames, price, period, strict),
                name: _full(frames, price, period, strict, spread),
            }
        ]

    return Indicator(
        label=name,
        family="STDDEV",
        settings={"period": period, "priceColumn": price},
        stored={"period": float(period)},
        outputs={"value": name},
        inputs=(price,),
        lookback=period - 1,
        levels=levels,
    )


def bollinger_indicator(
    period: int = 20,
    price: str = "close",
    width: float = 2.0,
    ddof: int = 1,
    strict: bool = False,
) -> Indicator:
    _positive(period=period)
    deviation = _deviation(price, ddof)
    middle, spread = "bollinger_middle", "_bollinger_spread"

    def levels(frames: Frames, runs: dict) -> list[Level]:
        return [
            {
                middle: _mean(frames, price, period, strict),
                spread: deviation.over(frames.last(period)) * width,
            },
            {
                "bollinger_upper": F.col(middle) + F.col(spread),
                "bollinger_lower": F.col(middle) - F.col(spread),
            },
        ]

    return Indicator(
        label=f"BOLLINGER_{period}",
        family="BOLLINGER",
        settings={"period": period, "priceColumn": price},
        stored={"period": float(period), "stddev": float(width)},
        outputs={"upper": "bollinger_upper", "middle": middle, "lower": "bollinger_lower"},
        inputs=(price,),
        lookback=period - 1,
        levels=levels,
    )


def rsi_indicator(period: int = 14, price: str = "close") -> Indicator:
    """Simple-mean RSI; the first row counts as no gain and no loss."""
    _positive(period=period)
    name, change = f"RSI_{period}", f"_change_{price}"

    def levels(frames: Frames, runs: dict) -> list[Level]:
        up = F.when(F.col(change) > 0, F.col(change)).otherwise(0.0)
        down = F.when(F.col(change) < 0, -F.col(change)).otherwise(0.0)
        frame = frames.last(period)
        return [
            {change: F.col(price) - frames.lag(F.col(price))},
            {
                f"_gain_{name}": F.avg(up).over(frame),
                f"_loss_{name}": F.avg(down).over(frame),
            },
            {name: rsi_from_averages(F.col(f"_gain_{name}"), F.col(f"_loss_{name}"))},
        ]

    return Indicator(
        label=name,
        family="RSI",
        settings={"period": period, "priceColumn": price},
        stored={"period": float(period)},
        outputs={"value": name},
        inputs=(price,),
        lookback=period,
        levels=levels,
    )


def stochastic_indicator(
    k: int = 14,
    d: int = 3,
    close: str = "close",
    high: str = "high",
    low: str = "low",
    strict: bool = False,
) -> Indicator:
    _positive(k=k, d=d)
    k_name, d_name = f"Stochastic_%K_{k}", f"Stochastic_%D_{k}_{d}"
    top, bottom = f"_highest_{k}", f"_lowest_{k}"

    def levels(frames: Frames, runs: dict) -> list[Level]:
        frame = frames.last(k)
        ratio = stochastic_k(F.col(close), F.col(bottom), F.col(top))
        return [
            {top: F.max(high).over(frame), bottom: F.min(low).over(frame)},
            {k_name: ratio},
            {d_name: _mean(frames, k_name, d, strict)},
        ]

    return Indicator(
        label="StochasticOscillator",
        family="STOCHASTIC",
        settings={
            "kPeriod": k,
            "dPeriod": d,
            "closeColumn": close,
            "highColumn": high,
            "lowColumn": low,
        },
        stored={"k": float(k), "d": float(d)},
        outputs={"k": k_name, "d": d_name},
        inputs=(close, high, low),
        lookback=k + d - 2,
        levels=levels,
    )


# The keys of ``settings`` and ``stored`` are those of stored records.


def _ema_settings(period: int, smoothing: float, price: str) -> dict[str, object]:
    return {"period": period, "smoothingFactor": smoothing, "priceColumn": price}


def ema_indicator(period: int = 12, smoothing: float = 2.0, price: str = "close") -> Indicator:
    """Recursive average seeded with the first price."""
    _positive(period=period)
    name, decay = f"EMA_{period}", Decay(period, smoothing)
    return Indicator(
        label=f"EMA{period}",
        family="EMA",
        settings=_ema_settings(period, smoothing, price),
        stored={"period": float(period), "smoothing": float(smoothing)},
        outputs={"value": name},
        inputs=(price,),
        lookback=decay.reach,
        levels=lambda frames, runs: ema_levels(frames, price, decay, runs[decay], name),
        decays=(decay,),
    )


def _one_step(frames: Frames, source: str, mean: str, decay: Decay) -> Column:
    """One smoothing step from the simple mean of the row before."""
    step = F.col(source) * decay.weight + frames.lag(F.col(mean)) * decay.kept
    return F.when(frames.first_row, F.col(mean)).otherwise(step)


def ema_one_step_indicator(
    period: int = 12, smoothing: float = 2.0, price: str = "close"
) -> Indicator:
    """One step from the simple mean of the row before; not recursive."""
    _positive(period=period)
    name, mean, decay = f"EMA_{period}", f"_mean_{price}_{period}", Decay(period, smoothing)
    return Indicator(
        label=f"EMA{period}",
        family="EMA",
        settings=_ema_settings(period, smoothing, price),
        stored={"period": float(period), "smoothing": float(smoothing)},
        outputs={"value": name},
        inputs=(price,),
        lookback=period,
        levels=lambda frames, runs: [
            {mean: _mean(frames, price, period)},
            {name: _one_step(frames, price, mean, decay)},
        ],
    )


def _macd(
    fast: int,
    slow: int,
    signal: int,
    smoothing: float,
    price: str,
    lookback: int,
    levels: Callable[[Frames, dict], list[Level]],
    decays: tuple[Decay, ...] = (),
) -> Indicator:
    return Indicator(
        label="MACD",
        family="MACD",
        settings={
            "fastPeriod": fast,
            "slowPeriod": slow,
            "signalPeriod": signal,
            "smoothingFactor": smoothing,
            "priceColumn": price,
        },
        stored={"fast": float(fast), "slow": float(slow), "signal": float(signal)},
        outputs={"line": "MACD", "signal": "MACD_Signal", "histogram": "MACD_Histogram"},
        inputs=(price,),
        lookback=lookback,
        levels=levels,
        decays=decays,
    )


def macd_indicator(
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    smoothing: float = 2.0,
    price: str = "close",
) -> Indicator:
    _positive(fast=fast, slow=slow, signal=signal)
    quick, calm, smooth = (Decay(n, smoothing) for n in (fast, slow, signal))
    quick_name, calm_name = f"EMA_{fast}", f"EMA_{slow}"

    def levels(frames: Frames, runs: dict) -> list[Level]:
        quick_sum, quick_ema = ema_levels(frames, price, quick, runs[quick], quick_name)
        calm_sum, calm_ema = ema_levels(frames, price, calm, runs[calm], calm_name)
        line = macd_line(F.col(quick_name), F.col(calm_name))
        signal_sum, signal_ema = ema_levels(frames, "MACD", smooth, runs[smooth], "MACD_Signal")
        return [
            {**quick_sum, **calm_sum},
            {**quick_ema, **calm_ema},
            {"MACD": line},
            signal_sum,
            signal_ema,
            {"MACD_Histogram": F.col("MACD") - F.col("MACD_Signal")},
        ]

    reach = max(quick.reach, calm.reach) + smooth.reach
    return _macd(fast, slow, signal, smoothing, price, reach, levels, (quick, calm, smooth))


def macd_one_step_indicator(
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    smoothing: float = 2.0,
    price: str = "close",
) -> Indicator:
    _positive(fast=fast, slow=slow, signal=signal)
    quick, calm, smooth = (Decay(n, smoothing) for n in (fast, slow, signal))
    quick_mean, calm_mean = f"_mean_{price}_{fast}", f"_mean_{price}_{slow}"
    line_mean = f"_mean_MACD_{signal}"

    def levels(frames: Frames, runs: dict) -> list[Level]:
        return [
            {quick_mean: _mean(frames, price, fast), calm_mean: _mean(frames, price, slow)},
            {
                f"EMA_{fast}": _one_step(frames, price, quick_mean, quick),
                f"EMA_{slow}": _one_step(frames, price, calm_mean, calm),
            },
            {"MACD": macd_line(F.col(f"EMA_{fast}"), F.col(f"EMA_{slow}"))},
            {line_mean: _mean(frames, "MACD", signal)},
            {"MACD_Signal": _one_step(frames, "MACD", line_mean, smooth)},
            {"MACD_Histogram": F.col("MACD") - F.col("MACD_Signal")},
        ]

    return _macd(fast, slow, signal, smoothing, price, max(fast, slow) + signal, levels)


def _obv(close: str, volume: str, **layout) -> Indicator:
    return Indicator(
        label="OBV",
        family="OBV",
        settings={"closeColumn": close, "volumeColumn": volume},
        stored={},
        outputs={"value": "OBV"},
        inputs=(close, volume),
        **layout,
    )


def obv_indicator(close: str = "close", volume: str = "volume") -> Indicator:
    """Running total of signed volume."""
    return _obv(
        close,
        volume,
        lookback=0,
        levels=lambda frames, runs: [],
        cumulative=(close, volume),
    )


def obv_two_step_indicator(close: str = "close", volume: str = "volume") -> Indicator:
    """Signed volume plus that of the row before; not cumulative."""

    def levels(frames: Frames, runs: dict) -> list[Level]:
        step = signed_volume(
            F.col(close), frames.lag(F.col(close)), checked_volume(F.col(volume))
        )
        total = F.col("_signed_volume") + F.coalesce(
            frames.lag(F.col("_signed_volume")), F.lit(0)
        )
        return [{"_signed_volume": step}, {"OBV": total}]

    return _obv(close, volume, lookback=2, levels=levels)


def default_indicators() -> list[Indicator]:
    """The seven indicators computed and stored for every bars table."""
    return [
        sma_indicator(20),
        bollinger_indicator(20),
        rsi_indicator(14),
        macd_indicator(12, 26, 9, 2.0),
        ema_indicator(12, 2.0),
        stochastic_indicator(14, 3),
        obv_indicator(),
    ]


def _merge(parts: Sequence[list[Level]]) -> list[Level]:
    depth = max((len(p) for p in parts), default=0)
    merged: list[Level] = [{} for _ in range(depth)]
    for part in parts:
        for level, columns in zip(merged, part, strict=False):
            level.update(columns)
    return [level for level in merged if level]


def running_obv(df: DataFrame, close: str, volume: str, series: Series) -> DataFrame:
    """Add OBV, POS: totals per slot first, then within each slot.

    The slot table carries what a slot needs from earlier ones: the rows before
    it, the close before it and the on-balance volume before it.
    """
    slotted, series = with_slots(df, series)
    window = series.slot_window()
    keys = [*series.keys, SLOT]
    size = checked_volume(F.col(volume))
    stepped = slotted.select(
        *keys,
        F.col(close).alias("_close"),
        size.alias("_volume"),
        F.row_number().over(window).alias("_row"),
        signed_volume(F.col(close), F.lag(close).over(window), size).alias("_inner"),
    )
    slots = stepped.groupBy(*keys).agg(
        F.count("*").alias(COUNT),
        F.sum("_inner").alias("_inner"),
        F.min_by("_close", "_row").alias("_first_close"),
        F.min_by("_volume", "_row").alias("_first_volume"),
        F.max_by("_close", "_row").alias("_last_close"),
    )
    in_order = series.slots_in_order()
    slots = rows_before(slots, series).withColumn(
        "_close_before", F.lag("_last_close").over(in_order)
    )
    edge = signed_volume(F.col("_first_close"), F.col("_close_before"), F.col("_first_volume"))
    slots = slots.withColumn("_total", F.col("_inner") + edge)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(
        *keys,
        BEFORE,
        "_close_before",
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_obv_before"),
    )
    rows = join_slots(slotted, slots, series)
    previous = F.coalesce(F.lag(close).over(window), "_close_before")
    rows = rows.withColumn("_signed", signed_volume(F.col(close), previous, size))
    so_far = F.sum("_signed").over(window.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("OBV", F.col("_obv_before") + so_far)
    return position_in_slots(rows, series).drop("_close_before", "_obv_before", "_signed")


def add_indicators(
    df: DataFrame, indicators: Sequence[Indicator], series: Series | None = None
) -> DataFrame:
    """Add the columns of all indicators to the bars."""
    series = Series.of(df, series)
    require_columns(df, [*series.keys, *series.order, *(c for i in indicators for c in i.inputs)])
    totals = {i.cumulative for i in indicators if i.cumulative}
    if len(totals) > 1:
        raise ValueError("one running OBV at a time")
    numbered = running_obv(df, *totals.pop(), series) if totals else number_rows(df, series)
    if all(not i.lookback and i.cumulative for i in indicators):
        return numbered if POS in df.columns else numbered.drop(POS)

    decays = list(dict.fromkeys(d for i in indicators for d in i.decays))
    shared = common_run(decays)
    runs = {d: shared or d.longest_run for d in decays}
    order = (run_name(shared), POS) if shared else (POS,)
    frames = Frames(series, order)

    lookback = max(i.lookback for i in indicators)
    blocked, size = in_blocks(numbered, series, lookback)
    blocked = blocked.withColumns({run_name(r): run_column(r) for r in set(runs.values())})
    for level in _merge([i.levels(frames, runs) for i in indicators]):
        blocked = blocked.withColumns(level)
    return own_rows(blocked, size, df.columns)


def enrich_all(
    df: DataFrame,
    indicators: Sequence[Indicator] | None = None,
    series: Series | None = None,
) -> DataFrame:
    """Bars with all indicators of the standard set (or the given ones)."""
    return add_indicators(df, indicators or default_indicators(), series)


def sma(
    df: DataFrame,
    period: int = 20,
    price: str = "close",
    strict: bool = False,
    series: Series | None = None,
) -> DataFrame:
    return add_indicators(df, [sma_indicator(period, price, strict)], series)


def rolling_stddev(
    df: DataFrame,
    period: int = 20,
    price: str = "close",
    ddof: int = 1,
    strict: bool = False,
    series: Series | None = None,
) -> DataFrame:
    """Rolling deviation; the mean of the same window is kept beside it."""
    return add_indicators(df, [stddev_indicator(period, price, ddof, strict)], series)


def bollinger(
    df: DataFrame,
    period: int = 20,
    price: str = "close",
    width: float = 2.0,
    ddof: int = 1,
    strict: bool = False,
    series: Series | None = None,
) -> DataFrame:
    return add_indicators(df, [bollinger_indicator(period, price, width, ddof, strict)], series)


def ema(
    df: DataFrame,
    period: int = 12,
    smoothing: float = 2.0,
    price: str = "close",
    series: Series | None = None,
) -> DataFrame:
    return add_indicators(df, [ema_indicator(period, smoothing, price)], series)


def ema_one_step(
    df: DataFrame,
    period: int = 12,
    smoothing: float = 2.0,
    price: str = "close",
    series: Series | None = None,
) -> DataFrame:
    return add_indicators(df, [ema_one_step_indicator(period, smoothing, price)], series)


def macd(
    df: DataFrame,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    smoothing: float = 2.0,
    price: str = "close",
    series: Series | None = None,
) -> DataFrame:
    return add_indicators(df, [macd_indicator(fast, slow, signal, smoothing, price)], series)


def macd_one_step(
    df: DataFrame,
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    smoothing: float = 2.0,
    price: str = "close",
    series: Series | None = None,
) -> DataFrame:
    return add_indicators(
        df, [macd_one_step_indicator(fast, slow, signal, smoothing, price)], series
    )


def rsi(
    df: DataFrame, period: int = 14, price: str = "close", series: Series | None = None
) -> DataFrame:
    return add_indicators(df, [rsi_indicator(period, price)], series)


def stochastic(
    df: DataFrame,
    k: int = 14,
    d: int = 3,
    close: str = "close",
    high: str = "high",
    low: str = "low",
    strict: bool = False,
    series: Series | None = None,
) -> DataFrame:
    return add_indicators(df, [stochastic_indicator(k, d, close, high, low, strict)], series)


def obv(
    df: DataFrame, close: str = "close", volume: str = "volume", series: Series | None = None
) -> DataFrame:
    return add_indicators(df, [obv_indicator(close, volume)], series)


def obv_two_step(
    df: DataFrame, close: str = "close", volume: str = "volume", series: Series | None = None
) -> DataFrame:
    return add_indicators(df, [obv_two_step_indicator(close, volume)], series)
