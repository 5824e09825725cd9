"""Articles by symbol as a stored table that a lookup reads a small part of."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsquant.operators.news import articles_by_symbol

BUCKETS = 64
BUCKET = "symbol_bucket"


def symbol_bucket(symbol: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def write_article_index(
    articles: DataFrame, path: str, buckets: int = BUCKETS, columns: Sequence[str] | None = None
) -> None:
    """Write one row per article and symbol, to be read by symbol.

    Rows lie in folders by a hash of the symbol, so a lookup opens one of ``buckets``;
    within a folder in ranges of symbol and time, with a bloom filter of symbols for every
    row group, so it skips the files and row groups of others. A symbol with very many
    articles fills files of its own. ``columns`` narrows what is stored of an article. Rows
    without a symbol are left out.
    """
    rows = articles_by_symbol(articles).where(F.col("symbol").isNotNull())
    if columns is not None:
        rows = rows.select("symbol", "timestamp", *[c for c in columns if c not in ("symbol", "timestamp")])
    rows = rows.drop("symbols").withColumn(BUCKET, symbol_bucket(F.col("symbol"), buckets))
    (
        rows.repartitionByRange(BUCKET, "symbol", "timestamp")
        .sortWithinPartitions(BUCKET, "symbol", "timestamp")
        .write.partitionBy(BUCKET)
        .option("parquet.bloom.filter.enabled#symbol", "true")
        .parquet(path)
    )


def read_article_index(
    spark: SparkSession,
    path: str,
    symbols: Sequence[str],
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Articles of some symbols; ``buckets`` as the table was written with.

    The buckets of the symbols prune folders, symbols and times reach the scan.
    """
    named = spark.createDataFrame([(s,) for s in dict.fromkeys(symbols)], "symbol string")
    wanted = [r[0] for r in named.select(symbol_bucket(F.col("symbol"), buckets)).distinct().collect()]
    rows = spark.read.parquet(path)
    rows = rows.where(F.col(BUCKET).isin(wanted) & F.col("symbol").isin(list(symbols))).drop(BUCKET)
    if since is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.where(F.col("timestamp") < F.lit(until).cast("timestamp"))
    return rows
