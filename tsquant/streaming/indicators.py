"""EMA and on-balance volume over a stream of bars, continued from batch to batch.

What a symbol carries over is one row in the engine's own state, keyed by symbol: it is
versioned with the checkpoint, so a batch that is run again starts from the state before
it, and only symbols that a batch has bars of are touched. Within a batch the bars of a
symbol are ordered by time and continued from that row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


STATE = "last_at timestamp, ema double, last_close double, last_obv bigint, late_bars bigint"


class Carried(NamedTuple):
    """The state of a symbol, in the order of `STATE`."""

    last_at: object = None
    ema: float | None = None
    last_close: float | None = None
    last_obv: int = 0
    late_bars: int = 0


def output_schema(period: int = 12) -> str:
    return f"symbol string, timestamp timestamp, close double, volume bigint, EMA_{period} double, OBV bigint"


def continued(bars: pd.DataFrame, before: Carried, period: int, smoothing: float) -> tuple[pd.DataFrame, Carried]:
    """Bars of one symbol newer than the state, one per time and in order, with their
    indicators; and the state after them.

    Of several bars of one time the largest (close, then volume) stays, as `dedup_bars`
    has it; the others, and bars no newer than the state, count as late.
    """
    met = len(bars)
    if before.last_at is not None:
        bars = bars[bars["timestamp"] > pd.Timestamp(before.last_at)]
    bars = bars.sort_values(["timestamp", "close", "volume"], ascending=[True, False, False], kind="stable")
    bars = bars.drop_duplicates("timestamp").reset_index(drop=True)
    late = before.late_bars + met - len(bars)
    if not len(bars):
        return bars.assign(ema=pd.Series(dtype=float), obv=pd.Series(dtype="int64")), before._replace(late_bars=late)
    close, volume = bars["close"].to_numpy(float), bars["volume"].to_numpy("int64")
    if not np.isfinite(close).all():
        raise ValueError(f"a price of {bars['symbol'].iloc[0]} is null or not finite, which an average carries on for ever")
    seed = [] if before.ema is None else [before.ema]
    # With adjust=False this is the recursion itself, from the seed or the first price.
    ema = pd.Series(np.concatenate((seed, close))).ewm(alpha=smoothing / (period + 1), adjust=False).mean()
    ema = ema.to_numpy()[len(seed) :]
    moves = np.sign(np.diff(close, prepend=close[0] if before.last_close is None else before.last_close))
    obv = before.last_obv + np.cumsum(moves.astype("int64") * volume)
    after = Carried(bars["timestamp"].iloc[-1].to_pydatetime(), float(ema[-1]), float(close[-1]), int(obv[-1]), late)
    return bars.assign(ema=ema, obv=obv), after


def indicator_stream(bars: DataFrame, period: int = 12, smoothing: float = 2.0) -> DataFrame:
    """EMA and OBV of every bar of a stream, as a stream (append mode).

    Feed it closed bars, such as the table ``stream_bars`` writes. A bar no newer
    than the state of its symbol is left out; the state counts those. Bars of one time
    within a batch are one bar. Null symbols are a symbol of their own; a null volume
    counts 0; a null or non-finite price fails the query, as in ``ema``.

    The bars that one batch has of one symbol are ordered in one task: at most one per
    time step of the bars, however many ticks are behind them. Bound a batch by the
    source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
    """
    if not 0 < smoothing / (period + 1) <= 1:
        raise ValueError("smoothing / (period + 1) must be above 0 and at most 1")
    names = [c.split()[0] for c in output_schema(period).split(", ")]

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = Carried(*state.get) if state.exists else Carried()
        done, after = continued(pd.concat(frames, ignore_index=True), before, period, smoothing)
        state.update(tuple(after))
        yield done.set_axis(names, axis=1)

    rows = bars.select(
        "symbol",
        F.col("timestamp").cast("timestamp"),
        F.col("close").cast("double"),
        F.coalesce(F.col("volume").cast("bigint"), F.lit(0)).alias("volume"),
    )
    return rows.groupBy("symbol").applyInPandasWithState(
        advance, output_schema(period), STATE, "append", GroupStateTimeout.NoTimeout
    )


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per symbol as of the last batch of a checkpoint: symbol and the columns of `STATE`."""
    stored = spark.read.format("statestore").load(checkpoint)
    return stored.select("key.*", "value.groupState.*")


def stream_indicators(
    bars: DataFrame,
    table: str,
    checkpoint: str,
    period: int = 12,
    smoothing: float = 2.0,
    **trigger,
) -> StreamingQuery:
    """Start a query that adds the indicators of every bar of the stream to a Parquet table.

    Given the same paths again it goes on where it stopped; a batch that is run again
    replaces nothing and adds nothing twice, as the table's log names the files of each
    batch once. ``trigger`` as for a stream writer; by default all that is there is
    processed.
    """
    return (
        indicator_stream(bars, period, smoothing)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(table)
    )
