"""Row-level formulas of the indicators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rsi_from_rs(rs: Column) -> Column:
    """100 - 100 / (1 + RS); RS = -1 is an error."""
    undefined = F.raise_error(F.lit("relative strength must not be -1")).cast("double")
    return F.when(rs == -1, undefined).otherwise(100.0 - F.lit(100.0) / F.nullif(1.0 + rs, F.lit(0.0)))


def rsi_from_averages(gain: Column, loss: Column) -> Column:
    """RSI of an average gain and loss; 100 when there was no loss."""
    return F.when(loss == 0, F.lit(100.0)).otherwise(rsi_from_rs(F.try_divide(gain, loss)))


def macd_line(fast: Column, slow: Column) -> Column:
    return fast - slow


def stochastic_k(close: Column, low: Column, high: Column) -> Column:
    """Place of the close between low and high in percent; 50 when they are equal."""
    return F.when(high == low, F.lit(50.0)).otherwise(
        F.try_divide(close - low, high - low) * 100
    )


def signed_volume(close: Column, previous: Column, volume: Column) -> Column:
    """+volume when the close rose, -volume when it fell, else 0."""
    return F.when(close > previous, volume).when(close < previous, -volume).otherwise(
        F.lit(0).cast("bigint")
    )


def checked_volume(volume: Column) -> Column:
    """The volume itself; a negative one fails the job."""
    negative = F.raise_error(F.lit("volume must not be negative")).cast("bigint")
    return F.when(volume < 0, negative).otherwise(volume)


def obv_step(previous_obv: Column, close: Column, previous: Column, volume: Column) -> Column:
    """One step of on-balance volume."""
    return previous_obv + signed_volume(close, previous, checked_volume(volume))


def ema_step(price: Column, previous_ema: Column, period: float, smoothing: float = 2.0) -> Column:
    """One step of the exponential moving average."""
    weight = smoothing / (1.0 + period)
    return price * weight + previous_ema * (1.0 - weight)
