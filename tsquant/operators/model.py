"""Lagged indicator features with a next-value label, walk-forward folds, and forecast errors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsquant.functions.series import Series, interval_micros, over_blocks


def lag_features(
    df: DataFrame,
    columns: Sequence[str],
    lags: Sequence[int] = (1, 2, 3),
    label: str = "close",
    series: Series | None = None,
) -> DataFrame:
    """``<column>_lag_<n>`` for every column and lag, and ``next_<label>``."""
    if not lags or min(lags) < 1:
        raise ValueError("lags must be positive")

    def levels(frames):
        added = {f"{c}_lag_{n}": frames.lag(F.col(f"`{c}`"), n) for c in columns for n in lags}
        return [{**added, f"next_{label}": frames.lead(F.col(f"`{label}`"))}]

    return over_blocks(df, levels, series, lookback=max(lags), lookahead=1)


def forecast_metrics(
    df: DataFrame,
    actual: str,
    predicted: str,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """RMSE and MAPE (percent) per key over rows that have both values; a zero
    actual value has no percentage error."""
    error = F.col(predicted) - F.col(actual)
    both = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return both.groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(error, F.col(actual)))) * 100).alias("mape"),
        F.count("*").alias("n"),
    )


def label_times(df: DataFrame, horizon: int = 1, series: Series | None = None) -> DataFrame:
    """Adds ``label_at``: when the value ``horizon`` rows on, a row's label, is known; NULL
    at the end of a series."""
    if horizon < 1:
        raise ValueError("the horizon must be positive")
    time = Series.of(df, series).time
    return over_blocks(df, lambda frames: [{"label_at": frames.lead(F.col(time), horizon)}], series, lookahead=horizon)


def walk_forward(
    df: DataFrame,
    start: datetime | str,
    step: str,
    folds: int,
    embargo: str | None = None,
    window: str | None = None,
    time: str = "timestamp",
    label_at: str = "label_at",
) -> DataFrame:
    """Rows with the folds they serve: ``fold`` (from 0) and ``is_test``.

    Fold k is tested on the rows from ``start`` + k steps on, for one step. It learns from
    rows before that whose label is known by then too (others are purged), and an
    ``embargo`` earlier still; with ``window`` only from rows no older than that at
    the start of the test. A row serves as many folds as learn from it, ``folds`` + 1 at
    most. Rows without a time serve none, rows without a label are only tested.
    """
    width = interval_micros(step)
    gap = interval_micros(embargo) if embargo else 0
    if folds < 1 or width <= 0:
        raise ValueError("there must be a fold and a step")
    first = F.unix_micros(F.lit(start).cast("timestamp"))
    at, known = (F.unix_micros(F.col(c).cast("timestamp")) - first for c in (time, label_at))
    tested = F.floor(at / width)
    # The first fold whose test begins no earlier than the label and the embargo after it.
    learns = F.greatest(F.ceil((known + gap) / width), tested + 1, F.lit(0))
    last = F.lit(folds - 1)
    if window is not None:
        last = F.least(last, F.floor((at + interval_micros(window)) / width))
    none = F.array().cast("array<struct<fold:int,is_test:boolean>>")
    train = F.transform(F.sequence(learns.cast("int"), last.cast("int")), lambda k: F.struct(k.alias("fold"), F.lit(False).alias("is_test")))
    test = F.array(F.struct(tested.cast("int").alias("fold"), F.lit(True).alias("is_test")))
    roles = F.concat(
        F.when(tested.between(0, folds - 1), test).otherwise(none), F.when(known.isNotNull() & (learns <= last), train).otherwise(none)
    )
    return df.select("*", F.inline(roles))


def line_forecasts(folds: DataFrame, feature: str, label: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows to be tested with ``forecast``: the least-squares line through feature and label of
    the rows that their fold learns from, per key; NULL where those give no line.

    Learned by partial aggregates: one row per fold and key meets the rows.
    """
    x, y = F.col(feature).cast("double"), F.col(label).cast("double")
    lines = folds.where(~F.col("is_test")).groupBy("fold", *keys).agg(
        F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_base")
    )
    tested = folds.where("is_test").join(lines, ["fold", *keys], "left")
    return tested.withColumn("forecast", F.col("_base") + F.col("_slope") * x).select(*folds.columns, "forecast")
