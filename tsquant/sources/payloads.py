"""Landed chart payloads and quote files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsquant.schemas import BAR, CHART, CORRUPT, QUOTE

EXTENSION = r"\.[^.]+?(\.(gz|bz2|zst|lz4|snappy|deflate))?$"


def parse_chart_payloads(df: DataFrame, payload: Column | str = "payload") -> DataFrame:
    """Add the parsed ``chart`` and, for text that is no JSON, ``_corrupt_record``.

    The schema is fixed: no pass over the data to infer one, and fields that are
    null everywhere keep their type. ``inline`` keeps later conditions on the
    result from being pushed into the parsing, which would repeat it for each.
    """
    column = F.col(payload) if isinstance(payload, str) else payload
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return df.select("*", F.inline(F.array(F.from_json(column, CHART, options))))


def read_chart_payloads(
    spark: SparkSession, path: str | Sequence[str], per_file: bool = False
) -> DataFrame:
    """Landed payloads of many symbols: one JSON document per line, or per file.

    ``requested_symbol``, for payloads that do not state their symbol, is the
    table partition of that name, or else the file name without its extension and
    that of its compression. Dots and leading zeros belong to the symbol.
    """
    paths = [path] if isinstance(path, str) else list(path)
    text = spark.read.text(paths, wholetext=per_file)
    requested = F.regexp_replace(F.col("_metadata.file_name"), EXTENSION, "")
    if "requested_symbol" in text.columns:
        # Stated as text, so that the partition's values are not taken for numbers.
        named = "value string, requested_symbol string"
        text = spark.read.schema(named).text(paths, wholetext=per_file)
        requested = F.col("requested_symbol")
    named = text.select(requested.alias("requested_symbol"), F.col("value").alias("payload"))
    return parse_chart_payloads(named).drop("payload")


def read_quote_csv(spark: SparkSession, path: str, keep_corrupt: bool = False) -> DataFrame:
    """Quote snapshots: Symbol,Price,High,Low,Timestamp with a header line.

    With ``keep_corrupt`` a line that does not read as that comes with its text in
    ``_corrupt_record``, as payloads do; without, its bad fields are null.
    """
    schema = T.StructType([*QUOTE.fields, *[T.StructField(CORRUPT, T.StringType())] * keep_corrupt])
    return (
        spark.read.schema(schema)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("header", True)
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def bars_from_rows(
    spark: SparkSession, rows: Sequence, schema: T.StructType = BAR
) -> DataFrame:
    """Bars given in the program."""
    return spark.createDataFrame(list(rows), schema)
