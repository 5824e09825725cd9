"""Wide indicator columns <-> long records with value and parameter maps.

Which column belongs to which indicator comes from the indicators themselves,
never from name patterns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsquant.operators.bars import month_bucket
from tsquant.operators.indicators import Indicator, default_indicators

OTHER = "OTHER"
KEYS = ("symbol", "timestamp")


def _registry(indicators: Sequence[Indicator] | None) -> Sequence[Indicator]:
    return default_indicators() if indicators is None else indicators


def indicator_columns(
    df: DataFrame, indicators: Sequence[Indicator] | None = None
) -> list[str]:
    """Columns of the frame that hold an indicator value."""
    names = [c for i in _registry(indicators) for c in i.outputs.values()]
    return [c for c in names if c in df.columns]


def _lookup(entries: dict[str, str], name: Column, default: str) -> Column:
    literals = [F.lit(x) for pair in entries.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*literals), name), F.lit(default))


def classify_indicator(name: Column, indicators: Sequence[Indicator] | None = None) -> Column:
    """Column name -> indicator type, OTHER when unknown."""
    types = {c: i.family for i in _registry(indicators) for c in i.outputs.values()}
    return _lookup(types, name, OTHER)


def classify_value(name: Column, indicators: Sequence[Indicator] | None = None) -> Column:
    """Column name -> value type (upper, signal, k, ...), 'value' when unknown."""
    kinds = {c: v for i in _registry(indicators) for v, c in i.outputs.items()}
    return _lookup(kinds, name, "value")


def _double_map(entries: dict[str, Column | float]) -> Column:
    if not entries:
        return F.from_json(F.lit("{}"), "map<string,double>")
    parts = []
    for key, value in entries.items():
        column = value if isinstance(value, Column) else F.lit(value)
        parts += [F.lit(key), column.cast("double")]
    return F.create_map(*parts)


def indicator_parameters(
    indicator_type: Column, indicators: Sequence[Indicator] | None = None
) -> Column:
    """Indicator type -> parameter map, empty when unknown."""
    chosen = F.lit(None).cast("map<string,double>")
    for indicator in _registry(indicators):
        chosen = F.when(
            indicator_type == indicator.family, _double_map(indicator.stored)
        ).otherwise(chosen)
    return F.coalesce(chosen, _double_map({}))


def unpivot_indicators(
    df: DataFrame,
    indicators: Sequence[Indicator] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per bar and indicator column."""
    columns = indicator_columns(df, indicators)
    doubles = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return doubles.unpivot(
        list(keys), [F.col(f"`{c}`") for c in columns], "indicator_name", "indicator_value"
    )


def group_indicator_maps(
    long: DataFrame,
    indicators: Sequence[Indicator] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Long rows -> one row per bar and indicator type with a value map.

    A group holds one row per output of one indicator, four at most.
    """
    name = F.col("indicator_name")
    entry = F.struct(classify_value(name, indicators), F.col("indicator_value"))
    return (
        long.withColumn("indicator_type", classify_indicator(name, indicators))
        .withColumn("_entry", entry)
        .groupBy(*keys, "indicator_type")
        .agg(F.map_from_entries(F.sort_array(F.collect_list("_entry"))).alias("values"))
    )


def add_keys(records: DataFrame, symbol: str | None = None) -> DataFrame:
    """Add the table keys: the symbol when the rows carry none, and the month."""
    if symbol is not None:
        records = records.withColumn("symbol", F.lit(symbol))
    return records.withColumn("date_bucket", month_bucket(F.col("timestamp")))


def to_indicator_records(
    df: DataFrame, indicators: Sequence[Indicator] | None = None
) -> DataFrame:
    """Wide bars -> rows of the indicator table.

    Every record depends on one bar only, so the records are built as an array
    on the bar and unpacked: no exchange.
    """
    records = []
    for indicator in _registry(indicators):
        present = {v: F.col(f"`{c}`") for v, c in indicator.outputs.items() if c in df.columns}
        if present:
            records.append(
                F.struct(
                    F.lit(indicator.family).alias("indicator_type"),
                    _double_map(present).alias("values"),
                    _double_map(indicator.stored).alias("parameters"),
                )
            )
    if not records:
        raise ValueError("no indicator columns found")
    return add_keys(df.select(*KEYS, F.inline(F.array(*records)))).select(
        "symbol", "date_bucket", "timestamp", "indicator_type", "values", "parameters"
    )


def read_indicator_value(
    records: DataFrame, wanted: Sequence[tuple[str, str]]
) -> DataFrame:
    """Records -> wide again: one column TYPE_value per (type, value type)."""
    types = list(dict.fromkeys(t for t, _ in wanted))
    kind = F.col("indicator_type")
    columns = [
        F.max(F.when(kind == t, F.try_element_at("values", F.lit(v)))).alias(f"{t}_{v}")
        for t, v in wanted
    ]
    return records.where(kind.isin(types)).groupBy(*KEYS).agg(*columns)
