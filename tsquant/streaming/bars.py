"""Bars over a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsquant.operators.bars import first_and_last, with_bucket


def read_tick_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Ticks landing as Parquet files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_kafka_ticks(
    spark: SparkSession, servers: str, topic: str, schema: T.StructType, **options: str
) -> DataFrame:
    """Ticks as JSON values of a Kafka topic; needs the Kafka connector."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("tick")).select("tick.*")


def stream_bars(
    ticks: DataFrame,
    interval: str = "1 minute",
    delay: str = "1 hour",
    price: str = "price",
    volume: str = "volume",
    time: str = "timestamp",
    tick_id: str | None = None,
) -> DataFrame:
    """Bars per symbol and event-time interval.

    Ticks later than ``delay`` are dropped. With ``tick_id`` a tick delivered
    twice within the delay counts once, and the id orders ticks of one instant.
    """
    timed = ticks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    order = [time]
    if tick_id is not None:
        timed = timed.dropDuplicatesWithinWatermark([tick_id])
        order.append(tick_id)
    opened, closed = first_and_last(timed, price, order)
    bars = timed.groupBy(F.window(time, interval), "symbol").agg(
        opened.alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        closed.alias("close"),
        F.sum(volume).alias("volume"),
    )
    return with_bucket(bars.withColumn("timestamp", F.col("window.start")))
