"""Running a stream to the end of what is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tsquant.functions.work import work_dir


def drain(
    stream: DataFrame,
    path: str | None = None,
    checkpoint: str | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Process all available input into a Parquet table and return that table.

    Append mode: rows still open under the watermark are not written. Given the
    same paths again, a later call continues where the earlier one stopped.
    """
    spark: SparkSession = stream.sparkSession
    path = path or work_dir(spark, "stream-table")
    checkpoint = checkpoint or work_dir(spark, "stream-state")
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partition_by)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)
