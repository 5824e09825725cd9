"""Exact quantiles per key without sorting a key's rows in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsquant.functions.skew import join_per_key

# Rank error of the sketch is at most 1 / ACCURACY of the rows of a key.
ACCURACY = 100_000
# (rows from which it holds, distance in probability on either side)
BRACKETS = ((0, None), (1_000, 0.005), (1_000_000, 0.00005))


def _bracket(sketch: Column, rows: Column, first: int, edge: Column) -> Column:
    bound = edge
    for number, (least, _) in enumerate(BRACKETS[1:]):
        bound = F.when(rows >= least, F.get(sketch, F.lit(first + number))).otherwise(bound)
    return bound


def exact_quantile(
    df: DataFrame, value: str, p: float, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Interpolated p-quantile per key, and count and mean of the values up to it.

    A sketch gives two bounds around the quantile that certainly enclose it. The
    rows below are only counted and summed, those between are counted per value
    (both partial aggregates); just these counts are put in order per key, which
    is a 1/10,000 part of a long series at most. Rows without key or value are
    not counted.
    """
    if not 0 <= p <= 1:
        raise ValueError("p must lie in [0, 1]")
    distances = [d for _, d in BRACKETS[1:]]
    marks = [max(0.0, p - d) for d in distances] + [min(1.0, p + d) for d in distances]
    # Stated up front for keys too, or the join adds it to one side only and what
    # leads up to both sides is computed twice.
    present = [F.col(c).isNotNull() for c in (*keys, value)]
    given = df.where(reduce(and_, present)).select(*keys, F.col(value).alias("_v"))
    bounds = given.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", marks, ACCURACY).alias("_marks"),
    )
    bounds = bounds.select(
        *keys,
        "n",
        _bracket(F.col("_marks"), F.col("n"), 0, F.col("_min")).alias("_low"),
        _bracket(F.col("_marks"), F.col("n"), len(distances), F.col("_max")).alias("_high"),
    )
    return quantile_within(given, bounds, p, keys)


def quantile_within(given: DataFrame, bounds: DataFrame, p: float, keys: Sequence[str]) -> DataFrame:
    """The p-quantile per key from values ``_v`` and bounds: ``n`` values in all, of which the
    quantile lies between ``_low`` and ``_high``; values above ``_high`` need not be given.
    Bounds that do not hold fail the job.
    """
    inside = F.when(F.col("_v") >= F.col("_low"), F.col("_v"))
    counts = (
        join_per_key(given, bounds, keys, "n", "_v")
        .where(F.col("_v") <= F.col("_high"))
        .groupBy(*keys, "n", inside.alias("_inside"))
        .agg(F.count("*").alias("_count"), F.sum("_v").alias("_sum"))
    )
    in_order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_inside"))
    upto = F.sum("_count").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    rank = (F.col("n") - 1) * F.lit(float(p))
    ranked = (
        counts.withColumn("_upto", upto)
        .withColumn("_rank", F.floor(rank))
        .withColumn("_part", rank - F.floor(rank))
    )
    missed = F.raise_error(F.lit("quantile lies outside its bounds")).cast("double")
    enclosed = F.coalesce(
        F.max(F.when(F.col("_inside").isNull(), F.col("_upto"))) <= F.max("_rank"), F.lit(True)
    )
    at = F.min(F.when(F.col("_upto") > F.col("_rank"), F.col("_inside")))
    after = F.min(F.when(F.col("_upto") > F.col("_rank") + 1, F.col("_inside")))
    in_tail = F.col("_upto") - F.col("_count") <= F.col("_rank")
    tail_n = F.sum(F.when(in_tail, F.col("_count")))
    tail_sum = F.sum(F.when(in_tail, F.col("_sum")))
    found = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.when(enclosed, at).otherwise(missed).alias("_at"),
        after.alias("_after"),
        F.max("_part").alias("_part"),
        tail_n.alias("tail_n"),
        (tail_sum / tail_n).alias("tail_mean"),
    )
    value_at = F.coalesce(F.col("_at"), missed)
    step = F.when(F.col("_part") > 0, (F.coalesce("_after", missed) - value_at) * F.col("_part"))
    quantile = value_at + F.coalesce(step, F.lit(0.0))
    return found.select(*keys, "n", quantile.alias("quantile"), "tail_n", "tail_mean")
