"""Newest rows and newest indicator values.

A rank filter directly over its window lets Spark cut every task's rows to the
newest n per key before the shuffle, so a long series never travels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsquant.functions.decay import Decay, finite
from tsquant.functions.series import POS, Series, number_rows
from tsquant.operators.indicators import ema

# Fixed value: the longest rank filter Spark cuts before the shuffle by default.
RANK_LIMIT = 1000


def latest_bars(
    df: DataFrame, n: int = 1, per_key: bool = True, series: Series | None = None
) -> DataFrame:
    """The newest n rows of every key, or of the whole table."""
    series = Series.of(df, series)
    newest = [F.desc(c) for c in series.order]
    if not per_key or not series.keys:
        return df.orderBy(*newest).limit(n)
    if n > RANK_LIMIT:
        # Positions come from slots, so no task sorts a whole series.
        totals = df.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("_rows"))
        rows = number_rows(df, series).join(totals, list(series.keys))
        return rows.where(F.col(POS) >= F.col("_rows") - n).select(*df.columns)
    rank = F.row_number().over(Window.partitionBy(*series.keys).orderBy(*newest))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest_sma(
    df: DataFrame,
    period: int = 20,
    price: str = "close",
    required: bool = False,
    series: Series | None = None,
) -> DataFrame:
    """Mean of the newest ``period`` values per key: NULL with fewer rows, or an
    error when ``required``."""
    series = Series.of(df, series)
    rows = latest_bars(df.select(*series.keys, *series.order, price), period, True, series)
    short = F.lit(None).cast("double")
    if required:
        short = F.raise_error(F.lit(f"fewer than {period} values")).cast("double")
    full = F.count(price) >= period
    return rows.groupBy(*series.keys).agg(
        F.when(full, F.avg(price)).otherwise(short).alias(f"SMA_{period}")
    )


def latest_ema(
    df: DataFrame,
    period: int = 12,
    smoothing: float = 2.0,
    price: str = "close",
    series: Series | None = None,
) -> DataFrame:
    """The exponential average at the newest row of every key.

    Only the newest rows with a weight that counts are kept; the oldest of them
    stands for the start of the series. Values must be finite, as for ``ema``; among
    the rows that are read one that is not fails the job.
    """
    series = Series.of(df, series)
    decay, name = Decay(period, smoothing), f"EMA_{period}"
    needed = max(1, decay.reach)
    if needed > RANK_LIMIT or not series.keys:
        return latest_bars(ema(df, period, smoothing, price, series), 1, True, series).select(
            *series.keys, name
        )
    newest = Window.partitionBy(*series.keys).orderBy(*[F.desc(c) for c in series.order])
    rows = (
        df.select(*series.keys, *series.order, price)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= needed)
    )
    kept = F.lit(decay.kept)
    age = F.col("_rank") - 1
    value = finite(price)
    weighted = F.sum(value * F.pow(kept, age) * decay.weight)
    start = F.max_by(value, "_rank") * F.pow(kept, F.max("_rank") - 1) * decay.kept
    return rows.groupBy(*series.keys).agg((weighted + start).alias(name))
