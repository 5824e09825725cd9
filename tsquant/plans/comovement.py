"""Co-movement of symbols kept as a table and advanced by new bars, old bars unread.

What is kept: of every period and pair of symbols the co-moments of returns over intervals
that have ended, which merge exactly with those of later ones; of every period and symbol
its last interval, from which the next return follows. An interval has ended when a bar
of any symbol lies in a later one; bars that come after that are left out of it, so all
symbols of an interval are counted at once.

A generation of the table holds both parts; its prices are written last, so a run that
fails leaves the generation before it as the newest, and running it again gives the same. A
load that comes twice counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsquant.operators.risk import (
    MOMENT_SCHEMA,
    bars_by_period,
    count_symbol_blocks,
    merge_moments,
    pair_moments,
    pearson,
)
from tsquant.sources.upkeep import drop_folder, folder_names, table_exists

PERIODS = ("day", "week", "month")
PRICES = "period string, symbol string, before double, start timestamp, close double, last_at timestamp"


class CoMoments:
    """The table under a path; `advance` it by bars, read `correlations` and `covariances`.

    ``value`` is the return that is kept, ``simple_return`` or ``log_return``; a path has one.
    """

    def __init__(
        self, spark: SparkSession, path: str, periods: Sequence[str] = PERIODS, value: str = "simple_return"
    ):
        self.spark, self.path, self.periods, self.value = spark, path.rstrip("/"), tuple(periods), value

    def generation(self) -> int:
        """The newest whole generation; 0 where there is none."""
        names = folder_names(self.spark, self.path)
        whole = [int(n) for n in names if n.isdigit() and table_exists(self.spark, f"{self.path}/{n}/prices/_SUCCESS")]
        return max(whole, default=0)

    def _read(self, generation: int, name: str, schema: str) -> DataFrame:
        if not generation:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{generation}/{name}")

    def prices(self) -> DataFrame:
        return self._read(self.generation(), "prices", PRICES)

    def moments(self) -> DataFrame:
        """Of intervals that are over."""
        return self._read(self.generation(), "moments", MOMENT_SCHEMA)

    def advance(self, bars: DataFrame, symbol_blocks: int | None = None) -> int:
        """Take in further bars; returns the newest generation.

        Bars without a price are left out, and so are those of intervals that have ended.
        The generation before the new one is kept, older ones are removed. Without a bar
        to take in nothing is written.
        """
        now = self.generation()
        prices, moments = (self._read(now, n, s) for n, s in (("prices", PRICES), ("moments", MOMENT_SCHEMA)))
        open_at = self._open(prices)
        coarse = bars_by_period(bars.where("close IS NOT NULL"), self.periods).withColumnRenamed("timestamp", "start")
        fresh = coarse.where(F.coalesce(F.col("start") >= open_at, F.lit(True)))
        base = f"{self.path}/{now + 1}"
        self._continued(prices, fresh).write.mode("overwrite").parquet(f"{base}/series")
        series = self.spark.read.parquet(f"{base}/series")
        if series.where("new").isEmpty():
            drop_folder(self.spark, base)
            return now
        # What ended before was counted before.
        ended = (F.col("start") < self._open(series)) & F.coalesce(F.col("start") >= open_at, F.lit(True))
        blocks = symbol_blocks or count_symbol_blocks(series)
        more = pair_moments(series.where(ended), self.value, period="period", symbol_blocks=blocks)
        merge_moments(moments.unionByName(more)).write.mode("overwrite").parquet(f"{base}/moments")
        new = series.where("last").select("period", "symbol", "before", "start", "close", "last_at")
        new.write.mode("overwrite").parquet(f"{base}/prices")
        drop_folder(self.spark, f"{base}/series")
        if now > 1:
            drop_folder(self.spark, f"{self.path}/{now - 1}")
        return now + 1

    def _open(self, rows: DataFrame) -> Column:
        """Start of the open interval of a row's period, null before the first bar."""
        found = {r["period"]: r["start"] for r in rows.groupBy("period").agg(F.max("start").alias("start")).collect()}
        at = F.lit(None).cast("timestamp")
        for period, start in found.items():
            at = F.when(F.col("period") == period, F.lit(start)).otherwise(at)
        return at

    def _continued(self, prices: DataFrame, fresh: DataFrame) -> DataFrame:
        """The last interval of every symbol and those that follow, with their returns.

        Of an interval met again the later price holds. Intervals are days or longer, so
        one symbol has few.
        """
        both = prices.withColumn("new", F.lit(False)).unionByName(
            fresh.select("period", "symbol", F.lit(None).cast("double").alias("before"), "start", "close", "last_at", F.lit(True).alias("new"))
        )
        seen = F.struct("last_at", ~F.col("new"))
        merged = both.groupBy("period", "symbol", "start").agg(
            F.max("before").alias("before"), F.max_by("close", seen).alias("close"), F.max("last_at").alias("last_at"),
            F.max_by("new", seen).alias("new"),
        )
        order = Window.partitionBy("period", "symbol").orderBy("start")
        before = F.coalesce("before", F.lag("close").over(order))
        last = F.lead("start").over(order).isNull().alias("last")
        ratio = F.try_divide("close", "before")
        return merged.select("period", "symbol", "start", "close", "last_at", "new", before.alias("before"), last).withColumns(
            {"timestamp": F.col("start"), "simple_return": ratio - 1, "log_return": F.ln(ratio)}
        )

    def to_date(self, symbol_blocks: int | None = None) -> DataFrame:
        """Co-moments with the open intervals as they stand: at most one return of each symbol more."""
        prices = self.prices()
        ratio = F.try_divide("close", "before")
        current = prices.where(F.col("start") == self._open(prices)).select(
            "period", "symbol", F.col("start").alias("timestamp"), (ratio - 1).alias("simple_return"), F.ln(ratio).alias("log_return")
        )
        blocks = symbol_blocks or count_symbol_blocks(prices)
        open_ = pair_moments(current, self.value, period="period", symbol_blocks=blocks)
        return merge_moments(self.moments().unionByName(open_))

    def correlations(self, symbol_blocks: int | None = None) -> DataFrame:
        """As `correlation_matrix` of all bars taken in."""
        pairs = self.to_date(symbol_blocks).where(F.col("symbol_a") < F.col("symbol_b"))
        return pairs.select("symbol_a", "symbol_b", "period", pearson().alias("correlation"), "n")

    def covariances(self, period: str = "day", symbol_blocks: int | None = None) -> DataFrame:
        """As `covariance_matrix` of the returns of one period."""
        pairs = self.to_date(symbol_blocks).where(F.col("period") == period)
        covariance: Column = F.try_divide(F.col("cross"), F.col("n") - 1)
        return pairs.select("symbol_a", "symbol_b", "mean_a", "mean_b", covariance.alias("covariance"), "n")
