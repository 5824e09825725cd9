"""Market-shaped views of the shared tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsquant.functions.series import Series
from tsquant.operators.bars import bars_from_ticks

HOURLY = Series.of_bars("hour")
DAILY = Series.of_bars("day")
TICKS = Series(tiebreak=("event_id",))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_ticks(events: DataFrame) -> DataFrame:
    """Events as ticks: the type is the symbol, the value the price, $.k the size."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("volume"),
        "event_id",
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return as_ticks(table(spark, folder, "events"))


def bars_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, folder), "hour", tiebreak=("event_id",))


def bars_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as trades: the priority is the symbol, the total the price."""
    trades = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_totalprice").alias("price"),
        F.lit(1).cast("bigint").alias("volume"),
        "o_orderkey",
    )
    return bars_from_ticks(trades, "day", tiebreak=("o_orderkey",))


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Chart payloads per symbol and day (24 hourly bars at most), with faults
    that depend on the day of the month and the volume of a bar."""
    bar = F.struct(
        F.unix_seconds("timestamp").alias("at"), "open", "high", "low", "close", "volume"
    )
    days = (
        bars_hourly(spark, folder)
        .groupBy("symbol", F.to_date("timestamp").alias("day"))
        .agg(F.sort_array(F.collect_list(bar)).alias("bars"))
        .withColumn("dom", F.dayofmonth("day"))
    )
    close = F.transform("bars", lambda b: F.when(b["volume"] % 10 != 0, b["close"]))
    volumes = F.col("bars.volume")
    short = F.slice(volumes, F.lit(1), F.size("bars") - 1)
    quote = F.struct(
        F.col("bars.open").alias("open"),
        close.alias("close"),
        F.col("bars.high").alias("high"),
        F.col("bars.low").alias("low"),
        F.when(F.col("dom") % 11 == 3, short).otherwise(volumes).alias("volume"),
    )
    symbol = F.when(F.col("dom") % 5 != 1, F.col("symbol"))
    result = F.struct(
        F.struct(F.lit("USD").alias("currency"), symbol.alias("symbol")).alias("meta"),
        F.col("bars.at").alias("timestamp"),
        F.struct(F.array(quote).alias("quote")).alias("indicators"),
    )
    results = F.filter(F.array(result), lambda _: F.col("dom") != 30)
    text = F.to_json(F.struct(F.struct(results.alias("result")).alias("chart")))
    half = F.substring(text, F.lit(1), (F.length(text) / 2).cast("int"))
    cut = F.when(F.col("dom") % 7 == 0, half).otherwise(text)
    copies = F.when(F.col("dom") % 6 == 2, 2).otherwise(1)
    return days.select(
        F.col("symbol").alias("requested_symbol"),
        "day",
        F.explode(F.array_repeat(cut, copies)).alias("payload"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Events as sentiment scores of a symbol with importance and keywords."""
    size = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("sentiment_score"),
        (size % 10 + 1).cast("int").alias("importance"),
        F.array(F.col("event_type"), F.concat(F.lit("k"), (size % 7).cast("string"))).alias("keywords"),
        "event_id",
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles, one a minute; labelled ones count as processed."""
    labels = table(spark, folder, "labels").select("doc_id", F.lit(True).alias("processed"))
    return (
        table(spark, folder, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").cast("string").alias("article_id"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("timestamp"),
            "source",
            F.col("text").alias("content"),
            F.array("lang", "source", "lang").alias("symbols"),
            F.coalesce("processed", F.lit(False)).alias("processed"),
        )
    )


def indices(spark: SparkSession, folder: str) -> DataFrame:
    """Part types as indices of brands; sectors weigh by the price of their parts."""
    part = _sectored_parts(spark, folder)
    sectors = part.groupBy("p_type", "sector").agg(
        F.sum("p_retailprice").alias("price"), F.collect_set("p_brand").alias("brands")
    )
    weighed = sectors.groupBy("p_type").agg(
        F.sum("price").alias("total"),
        F.collect_list(F.struct("sector", "price")).alias("sectors"),
        F.array_distinct(F.flatten(F.collect_list("brands"))).alias("composition"),
    )
    shares = F.transform(
        "sectors", lambda s: F.struct(s["sector"], (s["price"] / F.col("total")).alias("share"))
    )
    return weighed.select(
        F.lit("XX").alias("country"),
        F.col("p_type").alias("index_symbol"),
        "composition",
        F.map_from_entries(shares).alias("sector_weights"),
    )


def compositions(spark: SparkSession, folder: str) -> DataFrame:
    """Indices as they were rebalanced: in the n-th year only brands whose number is not n
    modulo 7 belong, some of them sent twice."""
    years = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n")
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    part = _sectored_parts(spark, folder).select("*", years).where(number % 7 != F.col("n"))
    sectors = part.groupBy("p_type", "n", "sector").agg(F.sum("p_retailprice").alias("price"), F.collect_set("p_brand").alias("brands"))
    total = F.sum("price")
    weights = F.map_from_entries(F.sort_array(F.collect_list(F.struct("sector", "price"))))
    whole = sectors.groupBy("p_type", "n").agg(
        weights.alias("prices"), total.alias("total"), F.array_distinct(F.flatten(F.collect_list("brands"))).alias("composition")
    )
    year = F.concat((F.col("n") + 1994).cast("string"), F.lit("-03-01")).cast("timestamp")
    rows = whole.select(
        F.lit("X").alias("country"), F.col("p_type").alias("index_symbol"), "composition",
        F.transform_values("prices", lambda _, v: v / F.col("total")).alias("sector_weights"), year.alias("last_rebalanced"),
    )
    return rows.unionByName(rows.where(F.month("last_rebalanced") == 3))


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """Brands as companies with a mean price."""
    return (
        _sectored_parts(spark, folder)
        .groupBy(F.col("p_brand").alias("company_symbol"), "sector")
        .agg(F.create_map(F.lit("price"), F.avg("p_retailprice")).alias("indexed_values"))
    )


def _sectored_parts(spark: SparkSession, folder: str) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    sector = F.concat(F.lit("S"), (number % 4).cast("string"))
    return table(spark, folder, "part").withColumn("sector", sector)


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as holdings of a customer in the order's priority."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("portfolio"),
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_totalprice").alias("amount"),
    )


# Scenario, symbol, relative change.
SHOCKS = [
    ("rate_hike", "1-URGENT", -0.08),
    ("rate_hike", "2-HIGH", -0.05),
    ("rate_hike", "3-MEDIUM", -0.03),
    ("rate_hike", "4-NOT SPECIFIED", 0.01),
    ("rate_hike", "5-LOW", 0.02),
    ("market_crash", "1-URGENT", -0.35),
    ("market_crash", "2-HIGH", -0.3),
    ("market_crash", "3-MEDIUM", -0.25),
    ("market_crash", "4-NOT SPECIFIED", -0.2),
    ("market_crash", "5-LOW", -0.1),
    ("geopolitical", "1-URGENT", -0.12),
    ("geopolitical", "3-MEDIUM", -0.06),
    ("geopolitical", "5-LOW", 0.04),
]


def shocks(spark: SparkSession) -> DataFrame:
    """The shocks as a local relation, whose size Spark knows."""
    columns = zip(("scenario", "symbol", "shock"), zip(*SHOCKS, strict=True), strict=True)
    return spark.createDataFrame(pa.table({name: list(values) for name, values in columns}))
