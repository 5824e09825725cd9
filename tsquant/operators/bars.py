"""Bars from ticks, coarser bars from bars, retention."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsquant.functions.series import interval_micros

CALENDAR_UNITS = ("week", "month", "quarter", "year")


def bar_start(time: Column, interval: str) -> Column:
    """Start of the interval a time falls in: a calendar unit ('month') or a
    fixed length ('15 minutes')."""
    if interval in CALENDAR_UNITS:
        return F.date_trunc(interval, time)
    width = interval_micros(interval)
    micros = F.unix_micros(time.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width)))


def month_bucket(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def first_and_last(df: DataFrame, value: str, order: list[str]) -> tuple[Column, Column]:
    """First and last value in an order of a time and tie-breaks.

    A whole-number tie-break makes one number with the time (micros times 2**64 plus
    the tie-break), which is aggregated without a sort; other tie-breaks need one.
    """
    by = F.col(order[0])
    if len(order) == 2 and isinstance(df.schema[order[1]].dataType, T.IntegralType):
        micros = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("decimal(20,0)")
        by = (micros * F.lit(Decimal(1 << 64)).cast("decimal(20,0)") + F.col(order[1])).cast("decimal(38,0)")
    elif len(order) > 1:
        by = F.struct(*order)
    return F.min_by(value, by), F.max_by(value, by)


def bars_from_ticks(
    ticks: DataFrame,
    interval: str = "minute",
    price: str = "price",
    volume: str = "volume",
    key: str = "symbol",
    time: str = "timestamp",
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Open, high, low, close and volume per key and interval.

    Everything is a partial aggregate, so a busy symbol shrinks to one row per
    interval and task before the shuffle.
    """
    opened, closed = first_and_last(ticks, price, [time, *tiebreak])
    bars = ticks.groupBy(F.col(key).alias("symbol"), bar_start(F.col(time), interval).alias("timestamp")).agg(
        opened.alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        closed.alias("close"),
        F.sum(volume).alias("volume"),
    )
    return with_bucket(bars)


def resample_bars(bars: DataFrame, interval: str = "day") -> DataFrame:
    """The same bars over a coarser interval."""
    merged = bars.groupBy("symbol", bar_start(F.col("timestamp"), interval).alias("start")).agg(
        F.min_by("open", "timestamp").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "timestamp").alias("close"),
        F.sum("volume").alias("volume"),
    )
    return with_bucket(merged.withColumnRenamed("start", "timestamp"))


def with_bucket(bars: DataFrame) -> DataFrame:
    """Bars in table order, with their month."""
    return bars.select(
        "symbol",
        month_bucket(F.col("timestamp")).alias("date_bucket"),
        "timestamp",
        "open",
        "high",
        "low",
        "close",
        "volume",
    )


def apply_retention(
    df: DataFrame, as_of: datetime | date | str, days: int = 30, time: str = "timestamp"
) -> DataFrame:
    """Rows no older than ``days`` at ``as_of``, counted from the time of the row."""
    oldest = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return df.where(F.col(time) >= oldest)
