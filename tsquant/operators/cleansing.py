"""Validation and cleansing of chart payloads and bars."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tsquant.operators.bars import with_bucket
from tsquant.schemas import CORRUPT

log = logging.getLogger(__name__)

# Columns and paths of the chart payload.
ARRAYS = ("timestamps", "opens", "closes", "highs", "lows", "volumes")
BAR_COLUMNS = ("timestamp", "open", "high", "low", "close", "volume")
CHART_PATHS = (
    "chart.result",
    "chart.result[0].meta.symbol",
    "chart.result[0].timestamp",
    "chart.result[0].indicators.quote[0].open",
    "chart.result[0].indicators.quote[0].close",
    "chart.result[0].indicators.quote[0].high",
    "chart.result[0].indicators.quote[0].low",
    "chart.result[0].indicators.quote[0].volume",
)


def require_paths(df: DataFrame, paths: Sequence[str] = CHART_PATHS) -> DataFrame:
    """Every path, nested ones included, must resolve against the schema."""
    for path in paths:
        try:
            df.selectExpr(path).schema  # noqa: B018  forces analysis
        except AnalysisException as error:
            raise ValueError(f"path not found: {path}") from error
    return df


def has_columns(df: DataFrame, required: Sequence[str]) -> bool:
    return set(required) <= set(df.columns)


def corrupt_report(df: DataFrame) -> DataFrame:
    """One row: corrupt, total, percent (0 of nothing is 0)."""
    bad = F.count_if(F.col(CORRUPT).isNotNull())
    share = F.coalesce(F.try_divide(bad * 100.0, F.count("*")), F.lit(0.0))
    return df.agg(bad.alias("corrupt"), F.count("*").alias("total"), share.alias("percent"))


def drop_corrupt(df: DataFrame, check: bool = False, examples: int = 5) -> DataFrame:
    """Keep the rows that parsed.

    With ``check`` one job counts the corrupt rows, logs them with a few examples
    and raises when nothing parsed.
    """
    if CORRUPT not in df.columns:
        return df
    if check:
        corrupt, total, percent = corrupt_report(df).first()
        log.warning("corrupt records: %d/%d (%.2f%%)", corrupt, total, percent)
        if corrupt:
            bad = df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)
            for row in bad.take(examples):
                log.warning("corrupt record: %s", row[0])
        if total and corrupt == total:
            raise ValueError("every record is corrupt")
    return df.where(F.col(CORRUPT).isNull())


def extract_chart(df: DataFrame, fallback: Column | str | None = None) -> DataFrame:
    """Symbol and six parallel arrays of ``chart.result[0]``.

    ``fallback`` names the symbol of payloads that state none: a value, or a
    column such as ``requested_symbol`` when many symbols are read together.
    """
    result = F.get(F.col("chart.result"), F.lit(0))
    quote = F.get(result["indicators"]["quote"], F.lit(0))
    symbol = result["meta"]["symbol"]
    if fallback is not None:
        symbol = F.coalesce(symbol, fallback if isinstance(fallback, Column) else F.lit(fallback))
    return df.select(
        symbol.alias("company_symbol"),
        result["timestamp"].alias("timestamps"),
        quote["open"].alias("opens"),
        quote["close"].alias("closes"),
        quote["high"].alias("highs"),
        quote["low"].alias("lows"),
        quote["volume"].alias("volumes"),
    )


def arrays_aligned() -> Column:
    """timestamps and opens are not empty and all six arrays equally long."""
    size = F.size("timestamps")
    aligned = (size > 0) & (F.size("opens") > 0)
    for name in ARRAYS[1:]:
        aligned = aligned & (size == F.size(name))
    return F.coalesce(aligned, F.lit(False))


def keep_aligned_arrays(df: DataFrame) -> DataFrame:
    return df.where(arrays_aligned())


def explode_bars(df: DataFrame) -> DataFrame:
    """One row per bar, epoch seconds as timestamp, month added."""
    rows = df.select(
        F.col("company_symbol").alias("symbol"),
        F.inline(F.arrays_zip(*[F.col(a) for a in ARRAYS])),
    )
    return with_bucket(
        rows.select(
            "symbol",
            F.timestamp_seconds("timestamps").alias("timestamp"),
            F.col("opens").alias("open"),
            F.col("highs").alias("high"),
            F.col("lows").alias("low"),
            F.col("closes").alias("close"),
            F.col("volumes").alias("volume"),
        )
    )


def drop_null_rows(df: DataFrame, columns: Sequence[str] = ("symbol", *BAR_COLUMNS)) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def dedup_bars(
    df: DataFrame,
    keys: Sequence[str] = ("symbol", "timestamp"),
    prefer: Sequence[Column] | None = None,
) -> DataFrame:
    """One row per key, always the same one.

    The survivor is the first in ``prefer`` order; by default the other columns
    decide, largest first. The rank filter is cut to one row per key and task
    before the shuffle, so many copies of one row do not meet in one task.
    """
    order = list(prefer or [F.desc_nulls_last(c) for c in df.columns if c not in keys])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.lit(0)])))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def require_timestamps(df: DataFrame, label: str = "") -> DataFrame:
    if df.where(F.col("timestamps").isNotNull()).isEmpty():
        raise ValueError(f"no timestamps found {label}".strip())
    return df


def require_non_empty(df: DataFrame, label: str = "") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no valid rows left {label}".strip())
    return df


def require_non_negative_volume(df: DataFrame, volume: str = "volume") -> DataFrame:
    if not df.where(F.col(volume) < 0).isEmpty():
        raise ValueError("volume must not be negative")
    return df


def clean_bars(
    payloads: DataFrame,
    fallback: Column | str | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Parsed payloads -> valid bars, one lazy plan.

    The counts that decide whether a load has failed are taken on the way
    (``observation``: payloads, corrupt, timed, aligned) instead of by jobs of
    their own; see ``check_load``.
    """
    require_paths(payloads)
    corrupt = F.col(CORRUPT) if CORRUPT in payloads.columns else F.lit(None)
    if observation is not None:
        result = F.get(F.col("chart.result"), F.lit(0))
        payloads = payloads.observe(
            observation,
            F.count(F.lit(1)).alias("payloads"),
            F.count_if(corrupt.isNotNull()).alias("corrupt"),
            F.count_if(result["timestamp"].isNotNull()).alias("timed"),
        )
    return (
        payloads.transform(drop_corrupt)
        .transform(extract_chart, fallback)
        .transform(keep_aligned_arrays)
        .transform(explode_bars)
        .transform(drop_null_rows)
        .transform(dedup_bars)
    )


def check_load(counts: dict[str, int], written: bool, label: str = "") -> None:
    """Raise the first reason why a load gave no bars."""
    log.info("payloads %(payloads)d, corrupt %(corrupt)d, with timestamps %(timed)d", counts)
    if written:
        return
    if counts["payloads"] and counts["corrupt"] == counts["payloads"]:
        raise ValueError("every record is corrupt")
    if not counts["timed"]:
        raise ValueError(f"no timestamps found {label}".strip())
    raise ValueError(f"no valid rows left {label}".strip())
