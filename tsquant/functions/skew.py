"""Joining rows to a table of one row per key when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with this many rows is hot: 10^12 rows have 100,000 such keys at most,
# a table of a few megabytes.
HOT_ROWS = 10_000_000
PIECES = 4096


def join_per_key(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, spread_by: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of rows with a table that has one row per key and its row count.

    Hot keys are told by the count. There are few of them by its nature, so the
    optimiser will broadcast them where their size allows. Their rows are spread over
    many tasks by ``spread_by`` instead of meeting in one; all other keys are joined
    in the normal way. ``hot_rows`` is what makes a key hot; the hot part of the table has
    no more rows than the number of rows divided by it.
    """
    columns = [c for c in table.columns if c not in keys]
    hot = table.where(F.col(count) >= hot_rows)
    hot = hot.select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in columns])
    # Always 0, but not as a literal: that would drop the piece from the join keys.
    cold_piece = (F.col(count) >= hot_rows).cast("int")
    cold = table.where(F.col(count) < hot_rows).withColumn("_piece", cold_piece)
    is_hot = F.col(f"_hot_{count}").isNotNull()
    piece = F.pmod(F.xxhash64(spread_by), F.lit(PIECES)).cast("int") + 1
    joined = (
        rows.join(hot, list(keys), "left")
        .withColumn("_piece", F.when(is_hot, piece).otherwise(0))
        .join(cold, [*keys, "_piece"], "left")
    )
    merged = [F.coalesce(f"_hot_{c}", c).alias(c) for c in columns]
    return joined.select(*rows.columns, *merged).where(F.col(count).isNotNull())
