"""Members of an index over time, from the compositions it had one after another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsquant.functions.series import interval_micros

KEYS = ("country", "index_symbol")
#: The end of what still holds, in microseconds; any time lies before it.
OPEN = (1 << 62) - 1


def composition_intervals(
    compositions: DataFrame, keys: Sequence[str] = KEYS, time: str = "last_rebalanced"
) -> DataFrame:
    """Compositions with the time they hold: from ``valid_from`` up to ``valid_to``, which is
    NULL for the last one.

    Of several compositions of one index and time the largest by its members counts, so
    the result is always the same. Compositions without a time are left out. An index
    has few of them, as many as it was rebalanced.
    """
    rows = compositions.where(F.col(time).isNotNull())
    own = F.struct(F.array_sort("composition").alias("members"), F.struct(F.array_sort(F.map_entries("sector_weights")).alias("w")))
    rest = [c for c in compositions.columns if c not in (*keys, time)]
    rows = rows.withColumn("_order", own).groupBy(*keys, time).agg(*[F.max_by(c, "_order").alias(c) for c in rest])
    order = Window.partitionBy(*keys).orderBy(time)
    return rows.withColumns({"valid_from": F.col(time), "valid_to": F.lead(time).over(order)})


def as_of_intervals(
    rows: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    time: str = "timestamp",
    bin_width: str = "30 days",
) -> DataFrame:
    """Rows with the columns of the interval of their keys that holds their time; rows that
    lie in none are left out.

    An interval is handed to the bins of time it covers, as far as rows reach, and meets
    the rows of a bin by keys and bin, so no row meets all intervals of its keys.
    Intervals hold from ``valid_from`` on and not at ``valid_to``. One pass over the rows
    finds the first and last time.
    """
    width = interval_micros(bin_width)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    least, most = rows.agg(F.min(at), F.max(at)).first()
    begin, end = F.unix_micros("valid_from"), F.coalesce(F.unix_micros("valid_to"), F.lit(OPEN))
    low, high = F.greatest(begin, F.lit(least)), F.least(end - 1, F.lit(most))
    bins = F.sequence(F.floor(low / width), F.floor(high / width))
    placed = intervals.where((low <= high) & F.lit(least is not None)).withColumn("_bin", F.explode(bins))
    found = rows.withColumn("_bin", F.floor(at / width)).join(placed, [*keys, "_bin"])
    inside = (at >= begin) & (at < end)
    added = [c for c in intervals.columns if c not in rows.columns]
    return found.where(inside).select(*rows.columns, *added)


def members_over_time(compositions: DataFrame, companies: DataFrame, sector: str = "sector") -> DataFrame:
    """Members of each composition with the time it holds, their sector and weight: the weight
    of the sector in the index at that time, shared equally by its members there."""
    held = composition_intervals(compositions)
    members = held.select(
        *KEYS, "valid_from", "valid_to", "sector_weights", F.explode(F.array_distinct("composition")).alias("company_symbol")
    ).join(companies.select("company_symbol", sector), "company_symbol", "left")
    together = Window.partitionBy(*KEYS, "valid_from", sector)
    weight = F.try_element_at("sector_weights", F.col(sector)) / F.count(F.lit(1)).over(together)
    return members.withColumn("weight", weight).drop("sector_weights")
