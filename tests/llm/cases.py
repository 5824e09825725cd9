"""Rows that every operator must take: nulls, empty, long, repeated, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = "lorem " * 30_000
ODD_TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (6, "x" * 50_000),
    (7, "The quick brown fox jumps over the lazy dog"),
    (7, "The quick brown fox jumps over the lazy dog"),
    (None, "a row without an id"),
    (None, None),
    (8, "naïve café 東京 \U0001f600 \x00 end"),
]
#: Names that operators give to columns of their own.
CLASHING = (
    "id", "ids", "n_tokens", "n_bytes", "score", "predicted", "n_shingles", "class", "component_id", "kept", "hits",
    "findings", "blob", "spans", "k0", "key", "part", "a", "b", "n", "lead", "decoded", "good", "h1", "text2",
)


def documents(spark: SparkSession, rows=ODD_TEXTS) -> DataFrame:
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return frame.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


def no_documents(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
