"""Tail risk of any window of months from a stored table, reading the tail only.

Returns are stored by month, in the order of their value, and for every symbol and month a
mergeable quantile sketch of them. The sketches of a window of months, merged per symbol,
enclose the quantile; what lies above the upper bound is never read beyond the row groups
that hold the bound, since files are ordered by value. Ranks come from exact counts of
what is read, so the result is exact; a bound that does not hold (a sketch errs with some
small probability) is told by the counts and widened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsquant.functions.work import work_dir
from tsquant.operators.bars import month_bucket
from tsquant.operators.quantile import quantile_within
from tsquant.sources.upkeep import in_partitions, replace_partitions, stored, table_exists, upsert_table

#: Size of a sketch; its ranks err by some 2.3 / SKETCH^0.97, which bounds are widened by this many times.
SKETCH, DEVIATIONS = 4096, 5
ERROR = 2.296 / SKETCH**0.9723
ORDER = ("value", "symbol", "timestamp")
PARTS = ("date_bucket",)
KINDS = "symbol string, timestamp timestamp, value double, date_bucket string"


class RiskTable:
    """Returns and their sketches under a path: `advance` it by returns, ask for `var_es`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.returns, self.sketches = f"{path.rstrip('/')}/returns", f"{path.rstrip('/')}/sketches"

    def advance(self, change: DataFrame, value: str = "simple_return") -> dict[str, int]:
        """Take in returns, in the place of those of their symbol and time; rows without a value are left out.

        Only months whose returns differ are written anew. The sketches of all months of
        the load are made anew after that, so a load that failed in between is mended by
        running it again. Returns the number of returns added and replaced.
        """
        rows = change.select("symbol", "timestamp", F.col(value).cast("double").alias("value"))
        rows = rows.where("value IS NOT NULL AND NOT isnan(value) AND symbol IS NOT NULL AND timestamp IS NOT NULL")
        rows = rows.withColumn("date_bucket", month_bucket(F.col("timestamp")))
        months = rows.select("date_bucket").distinct().collect()
        if not months:
            return {"added": 0, "replaced": 0}
        done = upsert_table(rows, self.returns, partition_by=PARTS, order_by=ORDER)
        held = in_partitions(self.spark.read.schema(KINDS).parquet(self.returns), months, PARTS)
        sketch = F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch")
        made = held.groupBy("symbol", "date_bucket").agg(F.count("*").alias("n"), F.max("value").alias("most"), sketch)
        replace_partitions(made, self.sketches, PARTS, ("symbol",))
        return done

    def bounds(self, first_month: str, last_month: str, p: float, widened: int = 1) -> DataFrame:
        """Of each symbol the number of returns in a window of months, and bounds of their p-quantile."""
        rows = stored(self.spark, self.sketches).where(F.col("date_bucket").between(first_month, last_month))
        merged = rows.groupBy("symbol").agg(
            F.sum("n").alias("n"), F.max("most").alias("_most"), F.kll_merge_agg_double("sketch").alias("_sketch")
        )
        # Both neighbours of the quantile are needed: of few returns all are read.
        off = 2 * ERROR * DEVIATIONS * widened
        many = F.col("n") * off >= 4
        none, most = F.lit(float("-inf")), F.col("_most")
        at = lambda rank: F.kll_sketch_get_quantile_double("_sketch", F.lit(rank))
        return merged.select(
            "symbol",
            "n",
            (F.when(many, at(p - off)).otherwise(none) if p > off else none).alias("_low"),
            (F.when(many, at(p + off)).otherwise(most) if p + off < 1 else most).alias("_high"),
        )

    def _pinned(self, bounds: DataFrame) -> DataFrame:
        """Bounds as they are now, written out: merging sketches again may give others."""
        path = work_dir(self.spark, "risk-bounds")
        bounds.write.parquet(path)
        return self.spark.read.schema(bounds.schema).parquet(path)

    def tail(self, first_month: str, last_month: str, bounds: DataFrame) -> DataFrame:
        """Returns of a window up to the highest upper bound, which the scan is told."""
        most = bounds.agg(F.max("_high")).first()[0]
        rows = self.spark.read.schema(KINDS).parquet(self.returns)
        rows = rows.where(F.col("date_bucket").between(first_month, last_month))
        return rows.where(F.col("value") <= F.lit(most)).select("symbol", F.col("value").alias("_v"))

    def var_es(self, first_month: str, last_month: str, confidence: float = 0.95) -> DataFrame:
        """Value at risk and expected shortfall per symbol over a window of months, as
        `historical_var_es` gives them for the returns of the window."""
        empty = "symbol string, n bigint, value_at_risk double, expected_shortfall double"
        if not table_exists(self.spark, self.sketches):
            return self.spark.createDataFrame([], empty)
        p, widened = 1.0 - confidence, 1
        while True:
            bounds = self._pinned(self.bounds(first_month, last_month, p, widened))
            given = self.tail(first_month, last_month, bounds)
            seen = given.join(bounds, "symbol").groupBy("symbol", "n").agg(
                F.count_if(F.col("_v") < F.col("_low")).alias("below"), F.count_if(F.col("_v") <= F.col("_high")).alias("upto")
            )
            rank = F.floor((F.col("n") - 1) * F.lit(p))
            missed = (F.col("below") > rank) | (F.col("upto") < F.least(rank + 2, F.col("n")))
            if seen.where(missed).isEmpty():
                break
            widened *= 4
        tail = quantile_within(given, bounds, p, ("symbol",))
        return tail.select(
            "symbol", "n", F.col("quantile").alias("value_at_risk"), F.col("tail_mean").alias("expected_shortfall")
        )
