"""Change of a score against an age ago, over a stream of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = "24 hours"


def stream_evolution(
    scores: DataFrame,
    score: str = "sentiment_score",
    age: str = DAY,
    lookback: str = "1 hour",
    delay: str = "1 hour",
    key: str = "symbol",
    time: str = "timestamp",
    row: Sequence[str] = (),
    out: str = "evolution_24h",
) -> DataFrame:
    """Scores with their change against the latest score at least ``age`` before; NULL
    without one.

    The stream is joined with itself over the interval of ``lookback`` before that age,
    under a watermark on either side, so state holds the scores of ``age`` and
    ``lookback`` and no older ones; of the scores that meet a row the latest one counts,
    the largest among those of one time. Each row meets the scores of its key within
    ``lookback``, so keep that as short as scores are dense. A row comes out once the
    watermark has passed it by ``age`` and ``lookback`` (append mode). Scores later than
    ``delay`` are dropped; a score older than ``lookback`` at that age counts as none,
    which is where this differs from ``sentiment_evolution``. ``row`` names the columns
    that tell rows of one key and time apart; equal rows are one.
    """
    columns = list(dict.fromkeys([key, time, *row, score]))
    timed = scores.withColumn(time, F.col(time).cast("timestamp"))
    own = timed.select(*columns).withWatermark(time, delay)
    before = timed.where(F.col(score).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(time).alias("_then"), F.col(score).alias("_score")
    )
    before = before.withWatermark("_then", delay)
    until = F.col(time) - F.expr(f"INTERVAL {age}")
    met = (
        (F.col(key) == F.col("_key"))
        & (F.col("_then") <= until)
        & (F.col("_then") >= until - F.expr(f"INTERVAL {lookback}"))
    )
    latest = F.max(F.when(F.col("_then").isNotNull(), F.struct("_then", "_score")))["_score"]
    found = own.join(before, met, "left_outer").groupBy(*columns).agg(latest.alias("_before"))
    return found.select(*columns, (F.col(score) - F.col("_before")).alias(out))
