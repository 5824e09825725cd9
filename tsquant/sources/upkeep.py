"""Upkeep of stored tables: keyed upserts and retention, by partitions.

Both write partitions anew beside the old ones and exchange them when the job commits
(Spark's dynamic partition overwrite), so a job that fails leaves the old files, and a
partition that is not concerned keeps its files as they are. Partition values come to
the driver, rows do not. One writer of a table at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsquant.operators.bars import month_bucket
from tsquant.operators.cleansing import dedup_bars
from tsquant.sources.tables import BARS_PARTITIONS, ROW_ORDER, STAMP

KEYS = ("symbol", "timestamp")
RECORD_KEYS = ("symbol", "timestamp", "indicator_type")


def _hadoop_path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def drop_folder(spark: SparkSession, path: str) -> None:
    files, found = _hadoop_path(spark, path)
    files.delete(found, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under a path; none where there is no such path."""
    files, found = _hadoop_path(spark, path)
    return [s.getPath().getName() for s in files.listStatus(found) if s.isDirectory()] if files.exists(found) else []


def table_exists(spark: SparkSession, path: str) -> bool:
    files, found = _hadoop_path(spark, path)
    return files.exists(found)


def stored(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """The table at a path, with the types of a frame that is to go into it."""
    spark.catalog.refreshByPath(path)
    return (spark.read.schema(like.schema) if like is not None else spark.read).parquet(path)


def fitted(df: DataFrame, path: str, partition_by: Sequence[str]) -> DataFrame:
    """The rows in the types of a stored table; other columns than the table's are refused."""
    held = {f.name: f.dataType for f in stored(df.sparkSession, path).schema.fields if f.name not in partition_by}
    if set(df.columns) - {STAMP} != set(held) - {STAMP} | set(partition_by):
        raise ValueError(f"the table has the columns {sorted({*held, *partition_by})}, the rows {sorted(df.columns)}")
    return df.select(*[F.col(c).cast(held[c]).alias(c) if c in held else F.col(c) for c in df.columns])


def in_partitions(df: DataFrame, partitions: Sequence[Row], partition_by: Sequence[str]) -> DataFrame:
    """Rows of some partitions. The values of each column prune the scan; which
    combinations of them are meant is a join with that short list."""
    values = [{r[c] for r in partitions} for c in partition_by]
    pruned = [
        F.col(c).isin([v for v in found if v is not None]) | (F.col(c).isNull() if None in found else F.lit(False))
        for c, found in zip(partition_by, values)
    ]
    df = df.where(reduce(and_, pruned))
    if len(partition_by) == 1:
        return df
    wanted = df.sparkSession.createDataFrame(list(partitions), df.select(*partition_by).schema).toDF(*[f"_{c}" for c in partition_by])
    return df.join(wanted, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in partition_by]), "left_semi")


def comparable(df: DataFrame, name: str, of: str = "") -> Column:
    """A column, or of a map its entries in order: what can be compared."""
    column = F.col(f"{of}.{name}" if of else name)
    return F.array_sort(F.map_entries(column)) if isinstance(df.schema[name].dataType, T.MapType) else column


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str], order_by: Sequence[str] = ROW_ORDER) -> None:
    """Write the partitions that the rows fall in anew; others stay."""
    order = list(dict.fromkeys([*partition_by, *order_by]))
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def upsert_table(
    df: DataFrame,
    path: str,
    keys: Sequence[str] = KEYS,
    partition_by: Sequence[str] = BARS_PARTITIONS,
    order_by: Sequence[str] = ROW_ORDER,
    prefer: Sequence[Column] | None = None,
    stamp: bool = False,
) -> dict[str, int]:
    """Put rows into a table in the place of rows with their key; others are added.

    Of several rows of one key the first in ``prefer`` order counts, as in
    ``dedup_bars``. Only partitions in which a row is new or differs from the stored
    one are written anew, so a load that is run again writes nothing. ``partition_by``
    must follow from the keys, or a row that changes its partition would stay in the
    old one too; null keys are equal to each other. With ``stamp`` a row notes when
    it was first written or last changed; the note is not compared.

    ``df`` is read several times; where it is costly, write it out first.

    Returns the number of rows added and replaced.
    """
    spark = df.sparkSession
    if prefer is None:
        prefer = [F.desc_nulls_last(comparable(df, c)) for c in df.columns if c not in keys]
    rows = dedup_bars(df, keys, prefer)
    noted = rows.withColumn(STAMP, F.current_timestamp()) if stamp else rows
    if not table_exists(spark, path):
        replace_partitions(noted, path, partition_by, order_by)
        return {"added": stored(spark, path, noted).count(), "replaced": 0}
    rows, noted = fitted(rows, path, partition_by), fitted(noted, path, partition_by)
    columns = rows.columns
    touched = rows.select(*partition_by).distinct().collect()
    if not touched:
        return {"added": 0, "replaced": 0}
    old = in_partitions(stored(spark, path, noted), touched, partition_by)
    same_key = reduce(and_, [F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}")) for k in keys])
    values = [c for c in columns if c not in keys]
    same = reduce(and_, [comparable(rows, c, "new").eqNullSafe(comparable(rows, c, "old")) for c in values], F.lit(True))
    met = rows.alias("new").join(old.withColumn("_held", F.lit(True)).alias("old"), same_key, "left")
    state = F.when(F.col("old._held").isNull(), "added").when(~same, "replaced")
    fresh = met.withColumn("_state", state).where(F.col("_state").isNotNull())
    found = fresh.groupBy(*[F.col(f"new.{c}").alias(c) for c in partition_by], "_state").count().collect()
    counts = {s: sum(r["count"] for r in found if r["_state"] == s) for s in ("added", "replaced")}
    if not found:
        return counts
    changed = list(dict.fromkeys(Row(**{c: r[c] for c in partition_by}) for r in found))
    incoming = in_partitions(rows, changed, partition_by)
    kept = in_partitions(stored(spark, path, noted), changed, partition_by)
    if stamp:
        # A row that is as it was keeps its note.
        note = kept.select(*[F.col(c).alias(f"_old_{c}") for c in columns], F.col(STAMP).alias("_noted"))
        as_it_was = reduce(and_, [comparable(incoming, c).eqNullSafe(comparable(note, f"_old_{c}")) for c in columns])
        incoming = incoming.join(note, as_it_was, "left").select(*columns, F.coalesce("_noted", F.current_timestamp()).alias(STAMP))
    rest = kept.alias("old").join(rows.select(*keys).alias("new"), same_key, "left_anti")
    replace_partitions(rest.unionByName(incoming), path, partition_by, order_by)
    return counts


def trim_table(
    spark: SparkSession,
    path: str,
    as_of: datetime | date | str,
    days: int = 30,
    time: str = "timestamp",
    month: str | None = "date_bucket",
    partition_by: Sequence[str] = BARS_PARTITIONS,
    order_by: Sequence[str] = ROW_ORDER,
) -> dict[str, int]:
    """Remove what is older than ``days`` at ``as_of`` from a stored table.

    Partitions that hold nothing but old rows are dropped as folders, those that hold
    both are written anew, all others keep their files. ``month`` names the partition
    column that holds the month of ``time``: all but the boundary month are then told by
    name, and only its rows are read. Pass None where months say nothing about
    ``time``, as for ``written_at``: one pass over that column tells. Rows without a
    time are kept. Returns the number of partitions dropped, rewritten and kept.
    """
    table = stored(spark, path)
    oldest = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    stays = F.col(time).isNull() | (F.col(time) >= oldest)
    where = F.col("_metadata.file_path").alias("_file")

    def counted(rows: DataFrame, stay: Column) -> list[Row]:
        counts = [F.count_if(stay).alias("stay"), F.count_if(~stay).alias("go"), F.min("_file").alias("file")]
        return rows.groupBy(*partition_by).agg(*counts).collect()

    if month is None:
        found = counted(table.select(*partition_by, time, where), stays)
    else:
        edge = spark.range(1).select(month_bucket(oldest)).first()[0]
        inside = F.coalesce(F.col(month) == edge, F.lit(True))
        found = counted(table.where(inside).select(*partition_by, time, where), stays)
        found += counted(table.where(~inside).select(*partition_by, where), F.col(month) > edge)
    mixed = [r for r in found if r["stay"] and r["go"]]
    gone = [r for r in found if not r["stay"]]
    if mixed:
        parts = [Row(**{c: r[c] for c in partition_by}) for r in mixed]
        replace_partitions(in_partitions(table, parts, partition_by).where(stays), path, partition_by, order_by)
    for r in gone:
        drop_folder(spark, r["file"].rsplit("/", 1)[0])
    spark.catalog.refreshByPath(path)
    return {"dropped": len(gone), "rewritten": len(mixed), "kept": len(found) - len(gone) - len(mixed)}
