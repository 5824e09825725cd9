"""Bars and indicator tables, partitioned, as Parquet or through another connector.

``format`` and ``options`` are those of Spark's reader and writer; a connector that
takes its place from an option gets it as ``path`` too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsquant.operators.cleansing import dedup_bars
from tsquant.schemas import BARS_TABLE, INDICATOR_RECORD

BARS_PARTITIONS = ("date_bucket",)
RECORD_PARTITIONS = ("date_bucket", "indicator_type")
ROW_ORDER = ("symbol", "timestamp")
STAMP = "written_at"


def append_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = BARS_PARTITIONS,
    order_by: Sequence[str] = ROW_ORDER,
    stamp: bool = False,
    by_range: bool = True,
    format: str = "parquet",
    options: dict[str, str] | None = None,
) -> bool:
    """Append and tell whether there was anything to append.

    ``by_range`` cuts the rows into ranges of (partition, symbol, time): tasks
    write equal shares however the rows spread, each file covers few symbols, and
    there are about as many files as tasks. Finding the ranges runs the last stage
    of ``df`` a second time; where that stage is costly, pass False: rows are then
    gathered per partition, and adaptive execution splits large partitions by size.

    The row count is observed during the write. With ``stamp`` each row notes when
    it was written, so that readers can let a later load of a bar replace an
    earlier one.
    """
    if stamp:
        df = df.withColumn(STAMP, F.current_timestamp())
    order = list(dict.fromkeys([*partition_by, *order_by]))
    placed = df.repartitionByRange(*order) if by_range else df.hint("rebalance", *partition_by)
    counted = Observation()
    (
        placed.sortWithinPartitions(*order)
        # Above the exchange: below it, sampling the ranges would count rows twice.
        .observe(counted, F.count(F.lit(1)).alias("rows"))
        .write.format(format)
        .options(**options or {})
        .mode("append")
        .partitionBy(*partition_by)
        .save(path)
    )
    return counted.get["rows"] > 0


def write_indicators(records: DataFrame, path: str, stamp: bool = False, **connector) -> bool:
    """Append indicator records; they come out of many windows, so not by range."""
    return append_table(records, path, RECORD_PARTITIONS, stamp=stamp, by_range=False, **connector)


def load(
    spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", options: dict[str, str] | None = None
) -> DataFrame:
    return spark.read.format(format).options(**options or {}).schema(schema).load(path)


def slice_rows(
    df: DataFrame,
    symbols: Sequence[str] | None,
    first_bucket: str | None,
    last_bucket: str | None,
) -> DataFrame:
    """Some symbols and months of a table, whatever connector it was loaded with."""
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    if first_bucket is not None:
        df = df.where(F.col("date_bucket") >= first_bucket)
    if last_bucket is not None:
        df = df.where(F.col("date_bucket") <= last_bucket)
    return df


def read_bars(
    spark: SparkSession,
    path: str,
    symbols: Sequence[str] | None = None,
    first_bucket: str | None = None,
    last_bucket: str | None = None,
    newest_load: bool = False,
    **connector,
) -> DataFrame:
    """Bars of some symbols and months. Months prune partitions; symbols reach the
    Parquet scan, where files and row groups of other symbols are skipped.

    ``newest_load`` keeps the bar written last where loads overlap.
    """
    stamp = [T.StructField(STAMP, T.TimestampType())] if newest_load else []
    schema = T.StructType([*BARS_TABLE.fields, *stamp])
    bars = slice_rows(load(spark, path, schema, **connector), symbols, first_bucket, last_bucket)
    if newest_load:
        order = [F.desc_nulls_last(STAMP)]
        order += [F.desc_nulls_last(c) for c in ("open", "high", "low", "close", "volume")]
        bars = dedup_bars(bars, prefer=order).drop(STAMP)
    return bars.select(*BARS_TABLE.fieldNames())


def read_indicators(
    spark: SparkSession,
    path: str,
    symbols: Sequence[str] | None = None,
    first_bucket: str | None = None,
    last_bucket: str | None = None,
    types: Sequence[str] | None = None,
    **connector,
) -> DataFrame:
    """Indicator records of some symbols, months and types."""
    loaded = load(spark, path, INDICATOR_RECORD, **connector)
    records = slice_rows(loaded, symbols, first_bucket, last_bucket)
    if types is not None:
        records = records.where(F.col("indicator_type").isin(list(types)))
    return records.select(*INDICATOR_RECORD.fieldNames())
