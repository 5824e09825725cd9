"""Returns, co-movement of symbols, tail risk and stress scenarios."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsquant.functions.series import UNIT_MICROS, Series, interval_micros, over_blocks
from tsquant.operators.bars import CALENDAR_UNITS, bar_start
from tsquant.operators.quantile import exact_quantile

# Symbols per side and bars per slice of one dense block of the pair products.
BLOCK_SYMBOLS = 256
SCENARIO_SLICES = 16
SLICE_BARS = 1024


def returns(
    bars: DataFrame, price: str = "close", series: Series | None = None
) -> DataFrame:
    """Simple and log return against the row before; NULL on the first."""
    previous = F.col("_previous")
    return over_blocks(
        bars,
        lambda frames: [
            {"_previous": frames.lag(F.col(price))},
            {
                "simple_return": F.try_divide(F.col(price), previous) - 1,
                "log_return": F.ln(F.try_divide(F.col(price), previous)),
            },
        ],
        series,
        lookback=1,
    )


def _slice_micros(interval: str) -> int:
    """Width of the time slices of a dense block."""
    # Calendar units are at least this many days long.
    days = {"week": 7, "month": 28, "quarter": 90, "year": 365}
    if interval in CALENDAR_UNITS:
        return SLICE_BARS * days[interval] * UNIT_MICROS["day"]
    return SLICE_BARS * interval_micros(interval)


def _dense(side: pd.DataFrame, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    symbols, column = np.unique(side["symbol"].to_numpy(), return_inverse=True)
    values = np.full((len(times), len(symbols)), np.nan)
    if side.duplicated(["symbol", "at"]).any():
        raise ValueError("more than one row of a symbol at one time")
    values[np.searchsorted(times, side["at"].to_numpy()), column] = side["x"].to_numpy()
    return symbols, values


def _block_moments(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts, means and centred products of all symbol pairs of one block."""
    diagonal = rows["left_block"].iat[0] == rows["right_block"].iat[0]
    left, right = rows[~rows["is_right"]], rows[rows["is_right"]]
    if diagonal:
        right = left
    times = np.unique(rows["at"].to_numpy())
    if len(times) > SLICE_BARS:
        raise ValueError("rows are closer than their interval")
    names_a, a = _dense(left, times)
    names_b, b = _dense(right, times)
    if not len(names_a) or not len(names_b):
        return pd.DataFrame(columns=MOMENT_COLUMNS)
    has_a, has_b = ~np.isnan(a), ~np.isnan(b)
    # Shifting each symbol by its own mean keeps the products small and exact.
    shift_a, shift_b = np.nanmean(a, axis=0), np.nanmean(b, axis=0)
    a, b = np.where(has_a, a - shift_a, 0.0), np.where(has_b, b - shift_b, 0.0)
    with_a, with_b = has_a.astype(float), has_b.astype(float)
    n = with_a.T @ with_b
    keep = n > 0
    if diagonal:
        keep &= names_a[:, None] <= names_b[None, :]
    i, j = np.nonzero(keep)
    n = n[i, j]
    mean_a, mean_b = (a.T @ with_b)[i, j] / n, (with_a.T @ b)[i, j] / n
    square_a = ((a * a).T @ with_b)[i, j] - n * mean_a**2
    square_b = (with_a.T @ (b * b))[i, j] - n * mean_b**2
    cross = (a.T @ b)[i, j] - n * mean_a * mean_b
    mean_a, mean_b = mean_a + shift_a[i], mean_b + shift_b[j]
    swap = names_a[i] > names_b[j]
    return pd.DataFrame(
        {
            "period": rows["period"].iat[0],
            "symbol_a": np.where(swap, names_b[j], names_a[i]),
            "symbol_b": np.where(swap, names_a[i], names_b[j]),
            "n": n.astype("int64"),
            "mean_a": np.where(swap, mean_b, mean_a),
            "mean_b": np.where(swap, mean_a, mean_b),
            "square_a": np.where(swap, square_b, square_a),
            "square_b": np.where(swap, square_a, square_b),
            "cross": cross,
        }
    )


MOMENT_SCHEMA = (
    "period string, symbol_a string, symbol_b string, n bigint, mean_a double, mean_b double,"
    " square_a double, square_b double, cross double"
)
MOMENT_COLUMNS = [field.split()[0] for field in MOMENT_SCHEMA.split(",")]


def count_symbol_blocks(df: DataFrame, key: str = "symbol") -> int:
    """Blocks for the symbols of a table. One pass over the key column; measure it
    on the table the rest is derived from, not on a costly derived one."""
    symbols = df.agg(F.approx_count_distinct(key)).first()[0]
    return max(1, -(-symbols // BLOCK_SYMBOLS))


def pair_moments(
    df: DataFrame,
    value: str,
    interval: str = "day",
    period: str | None = None,
    key: str = "symbol",
    time: str = "timestamp",
    symbol_blocks: int | None = None,
) -> DataFrame:
    """Co-moments of every pair of symbols over the times both have a value.

    A blocked matrix product: symbols are hashed into blocks, time into slices,
    and each (slice, block, block) is one small dense product. A row is sent to
    as many groups as there are blocks; the rows of a time are never paired one
    by one, so what is shuffled afterwards is one row per pair and slice.
    Values are taken relative to the mean of their symbol, so that a high level
    costs no digits; a null or NaN value counts as missing. A second row of one
    (key, time) fails the job, and so do rows closer than ``interval``, of which a
    slice would have no bound. ``period`` names a column of intervals instead, each
    of which is treated by itself.
    """
    blocks = symbol_blocks or count_symbol_blocks(df, key)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    width = F.lit(_slice_micros(interval))
    for unit in CALENDAR_UNITS if period else ():
        width = F.when(F.col(period) == unit, F.lit(_slice_micros(unit))).otherwise(width)
    x = F.col(value).cast("double")
    known = df.where(x.isNotNull() & ~F.isnan(x)).select(
        "*", (F.col(period) if period else F.lit(interval)).alias("_period"), F.col(key).alias("_symbol"), x.alias("_x")
    )
    # A symbol that does not move is shifted by its value, to exactly 0.
    shift = F.when(F.min("_x") == F.max("_x"), F.min("_x")).otherwise(F.avg("_x"))
    shifts = known.groupBy("_period", "_symbol").agg(shift.alias("_shift"))
    rows = known.join(shifts, ["_period", "_symbol"]).select(
        F.col("_period").alias("period"),
        F.col("_symbol").alias("symbol"),
        at.alias("at"),
        (F.col("_x") - F.col("_shift")).alias("x"),
        F.floor(at / width).alias("slice"),
        F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("own"),
    )
    partners = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    groups = rows.withColumn("other", partners).select(
        "period",
        "symbol",
        "at",
        "x",
        "slice",
        F.least("own", "other").alias("left_block"),
        F.greatest("own", "other").alias("right_block"),
        (F.col("own") > F.col("other")).alias("is_right"),
    )
    partial = groups.groupBy("period", "slice", "left_block", "right_block").applyInPandas(
        _block_moments, MOMENT_SCHEMA
    )
    n = F.col("n")
    sums = partial.groupBy("period", "symbol_a", "symbol_b").agg(
        F.sum(n).alias("n"),
        (F.sum(n * F.col("mean_a")) / F.sum(n)).alias("mean_a"),
        (F.sum(n * F.col("mean_b")) / F.sum(n)).alias("mean_b"),
        F.sum(F.col("square_a") + n * F.col("mean_a") ** 2).alias("square_a"),
        F.sum(F.col("square_b") + n * F.col("mean_b") ** 2).alias("square_b"),
        F.sum(F.col("cross") + n * F.col("mean_a") * F.col("mean_b")).alias("cross"),
    )
    square_a = F.greatest(F.col("square_a") - n * F.col("mean_a") ** 2, F.lit(0.0))
    square_b = F.greatest(F.col("square_b") - n * F.col("mean_b") ** 2, F.lit(0.0))
    of_a = shifts.select(F.col("_period").alias("period"), F.col("_symbol").alias("symbol_a"), F.col("_shift").alias("shift_a"))
    of_b = shifts.select(F.col("_period").alias("period"), F.col("_symbol").alias("symbol_b"), F.col("_shift").alias("shift_b"))
    return sums.join(of_a, ["period", "symbol_a"]).join(of_b, ["period", "symbol_b"]).select(
        "period",
        "symbol_a",
        "symbol_b",
        "n",
        (F.col("mean_a") + F.col("shift_a")).alias("mean_a"),
        (F.col("mean_b") + F.col("shift_b")).alias("mean_b"),
        square_a.alias("square_a"),
        square_b.alias("square_b"),
        (F.col("cross") - n * F.col("mean_a") * F.col("mean_b")).alias("cross"),
    )


def merge_moments(parts: DataFrame) -> DataFrame:
    """Co-moments of disjoint sets of times, one row for each period and pair.

    Centred sums are moved to the common mean; they are never undone into raw sums, so
    parts whose means lie close lose no digits, however far the means are from 0.
    """
    n = F.col("n")
    keys = ["period", "symbol_a", "symbol_b"]
    # A level near all means of a pair: of it, differences are exact enough to square.
    levels = parts.groupBy(*keys).agg(F.min("mean_a").alias("_a"), F.min("mean_b").alias("_b"))
    off_a, off_b = F.col("mean_a") - F.col("_a"), F.col("mean_b") - F.col("_b")
    sums = parts.join(levels, keys).groupBy(*keys, "_a", "_b").agg(
        F.sum(n).alias("n"),
        (F.sum(n * off_a) / F.sum(n)).alias("_off_a"),
        (F.sum(n * off_b) / F.sum(n)).alias("_off_b"),
        F.sum(F.col("square_a") + n * off_a**2).alias("_square_a"),
        F.sum(F.col("square_b") + n * off_b**2).alias("_square_b"),
        F.sum(F.col("cross") + n * off_a * off_b).alias("_cross"),
    )
    return sums.select(
        *keys,
        "n",
        (F.col("_a") + F.col("_off_a")).alias("mean_a"),
        (F.col("_b") + F.col("_off_b")).alias("mean_b"),
        F.greatest(F.col("_square_a") - n * F.col("_off_a") ** 2, F.lit(0.0)).alias("square_a"),
        F.greatest(F.col("_square_b") - n * F.col("_off_b") ** 2, F.lit(0.0)).alias("square_b"),
        (F.col("_cross") - n * F.col("_off_a") * F.col("_off_b")).alias("cross"),
    )


def pearson() -> Column:
    """Correlation from co-moments; NULL where one of the two did not move."""
    return F.try_divide("cross", F.sqrt("square_a") * F.sqrt("square_b"))


def bars_by_period(bars: DataFrame, periods: Sequence[str]) -> DataFrame:
    """Closing prices per symbol for several intervals of a day or more, from one
    pass over the bars, and when each was last seen."""
    start = F.lit(None).cast("timestamp")
    for period in periods:
        if period != "day" and period not in CALENDAR_UNITS:
            raise ValueError(f"not a period: {period!r}")
        first = bar_start(F.col("timestamp"), period)
        start = F.when(F.col("period") == period, first).otherwise(start)
    return (
        bars.withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))
        .groupBy("period", "symbol", start.alias("start"))
        .agg(F.max_by("close", "timestamp").alias("close"), F.max("timestamp").alias("last_at"))
        .withColumnRenamed("start", "timestamp")
    )


def correlation_matrix(
    bars: DataFrame,
    periods: Sequence[str] = ("day", "week", "month"),
    value: str = "simple_return",
    symbol_blocks: int | None = None,
) -> DataFrame:
    """Pearson correlation of returns for each period and pair of symbols, in
    long form; NULL where one of the two did not move."""
    blocks = symbol_blocks or count_symbol_blocks(bars)
    coarse = bars_by_period(bars, periods)
    change = returns(coarse, "close", Series.of_bars("day").with_keys("period", "symbol"))
    pairs = pair_moments(change, value, period="period", symbol_blocks=blocks)
    return pairs.where(F.col("symbol_a") < F.col("symbol_b")).select(
        "symbol_a",
        "symbol_b",
        "period",
        pearson().alias("correlation"),
        "n",
    )


def covariance_matrix(
    change: DataFrame,
    value: str = "simple_return",
    interval: str = "day",
    symbol_blocks: int | None = None,
) -> DataFrame:
    """Means and sample covariance of pairs of symbols, each with itself included."""
    pairs = pair_moments(change, value, interval, symbol_blocks=symbol_blocks)
    return pairs.select(
        "symbol_a",
        "symbol_b",
        "mean_a",
        "mean_b",
        F.try_divide(F.col("cross"), F.col("n") - 1).alias("covariance"),
        "n",
    )


def historical_var_es(
    change: DataFrame, value: str = "simple_return", confidence: float = 0.95
) -> DataFrame:
    """Value at risk (the 1 - confidence quantile of returns) and expected
    shortfall (mean of the returns up to it) per symbol."""
    tail = exact_quantile(change, value, 1.0 - confidence)
    return tail.select(
        "symbol",
        "n",
        F.col("quantile").alias("value_at_risk"),
        F.col("tail_mean").alias("expected_shortfall"),
    )


def scenario_impact(
    positions: DataFrame,
    shocks: DataFrame,
    portfolio: str = "portfolio",
    key: str = "symbol",
    amount: str = "amount",
) -> DataFrame:
    """Profit or loss of every portfolio under every scenario.

    A symbol without a shock in a scenario does not move there, so ``exposure`` is
    all that a portfolio holds. Positions are added up per portfolio and symbol
    before they meet the shocks (scenario, symbol, shock). Each scenario stands for one
    row of every portfolio; they meet by slices of the scenarios' names.
    """
    name = F.col("scenario")
    names = shocks.select(name).where(name.isNotNull()).distinct()
    names = names.withColumn("_slice", F.pmod(F.xxhash64(name), F.lit(SCENARIO_SLICES)).cast("int"))
    held = positions.groupBy(portfolio, key).agg(F.sum(amount).alias("held"))
    whole = held.groupBy(portfolio).agg(F.sum("held").alias("exposure"))
    slices = F.explode(F.sequence(F.lit(0), F.lit(SCENARIO_SLICES - 1))).alias("_slice")
    whole = whole.select("*", slices).join(names, "_slice").drop("_slice")
    moved = held.join(shocks, key).groupBy(portfolio, "scenario").agg(F.sum(F.col("held") * F.col("shock")).alias("impact"))
    moved = moved.withColumnRenamed(portfolio, "_of")
    same = F.col(portfolio).eqNullSafe(F.col("_of")) & (whole["scenario"] == moved["scenario"])
    return whole.join(moved, same, "left").select(
        portfolio, whole["scenario"], F.coalesce("impact", F.lit(0.0)).alias("impact"), "exposure"
    )
