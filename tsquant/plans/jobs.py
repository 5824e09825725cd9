"""The two jobs: payloads -> bars table, bars table -> indicator table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from tsquant.functions.series import Series
from tsquant.functions.work import work_dir
from tsquant.operators.cleansing import check_load, clean_bars
from tsquant.operators.indicators import Indicator, default_indicators, enrich_all
from tsquant.operators.reshape import to_indicator_records
from tsquant.sources.payloads import read_chart_payloads
from tsquant.sources.tables import RECORD_PARTITIONS, append_table, load, read_bars, write_indicators
from tsquant.sources.upkeep import RECORD_KEYS, drop_folder, upsert_table


def ingest_payloads(
    spark: SparkSession,
    payloads: str | Sequence[str],
    bars_table: str,
    per_file: bool = False,
    stamp: bool = False,
    upsert: bool = False,
) -> dict[str, int]:
    """Clean the landed payloads of any number of symbols into the bars table.

    One job reads, checks and writes. Raises when nothing valid was found, in
    which case nothing was written either; otherwise returns the counts. With
    ``upsert`` the bars take the place of stored ones of their symbol and time, so a
    load that is run again changes nothing; the counts also say how many were
    ``added`` and ``replaced``.
    """
    counts = Observation()
    raw = read_chart_payloads(spark, payloads, per_file)
    bars = clean_bars(raw, F.col("requested_symbol"), counts)
    if not upsert:
        written = append_table(bars, bars_table, stamp=stamp)
        check_load(counts.get, written)
        return counts.get
    # Payloads are parsed once: what they hold is compared with the table from a copy.
    landing = work_dir(spark, "load")
    written = append_table(bars, landing)
    check_load(counts.get, written)
    done = upsert_table(load(spark, landing, bars.schema), bars_table, stamp=stamp)
    drop_folder(spark, landing)
    return {**counts.get, **done}


def compute_indicators(
    spark: SparkSession,
    bars_table: str,
    records_table: str,
    symbols: Sequence[str] | None = None,
    first_bucket: str | None = None,
    last_bucket: str | None = None,
    indicators: Sequence[Indicator] | None = None,
    series: Series | None = None,
    newest_load: bool = False,
    stamp: bool = False,
    upsert: bool = False,
) -> bool:
    """Compute and store the indicators of a slice of the bars table; tell whether
    anything was stored.

    Series run through all months read; ``Series(keys=("symbol", "date_bucket"))``
    starts them anew each month. With ``upsert`` records take the place of stored ones of
    their symbol, time and type.
    """
    chosen = default_indicators() if indicators is None else indicators
    bars = read_bars(spark, bars_table, symbols, first_bucket, last_bucket, newest_load)
    records = to_indicator_records(enrich_all(bars, chosen, series), chosen)
    if not upsert:
        return write_indicators(records, records_table, stamp)
    landing = work_dir(spark, "records")
    write_indicators(records, landing)
    done = upsert_table(
        load(spark, landing, records.schema), records_table, RECORD_KEYS, RECORD_PARTITIONS, stamp=stamp
    )
    drop_folder(spark, landing)
    return sum(done.values()) > 0
