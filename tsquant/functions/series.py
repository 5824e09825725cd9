"""Ordered windows over long series that never put one series into one task.

``Window.partitionBy("symbol")`` sorts a whole symbol in one task, so a symbol
holding a third of the table decides how long the job takes. Here the series is
cut twice, both times by rules that depend on the data alone (a retried task
gives the same rows):

1. *Slots* are slices of time. Counting rows per (key, slot) is a small
   aggregation with map-side combine; its running sum gives the number of rows
   before each slot, so ``row_number`` inside a slot yields the exact position
   of every row in its series.
2. *Blocks* are runs of ``block_rows`` consecutive positions. Every block also
   receives copies of the few rows before it (and after it, for leads) that its
   windows look at. Windows then run per (key, block), all of the same size, and
   the copies are dropped at the end.

The only thing sorted per key is the slot table: one row per slot, not per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

POS = "_pos"
SLOT = "_slot"
BLOCK = "_block"
BEFORE = "_before"
COUNT = "_n"

HOUR_MICROS = 3_600_000_000
SLOT_ROWS = 1 << 18
# An hour is hot with this many times the rows of the others (or of a slot).
HOT_HOUR = 4
MOST_PARTS = 1 << 24
BLOCK_ROWS = 1 << 16

# Length of one interval unit in microseconds.
UNIT_MICROS = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}


def interval_micros(interval: str) -> int:
    """'15 minutes' or 'hour' in microseconds."""
    parts = interval.split()
    count, unit = (int(parts[0]), parts[1]) if len(parts) == 2 else (1, parts[0])
    unit = unit.lower().removesuffix("s")
    if unit not in UNIT_MICROS or count < 1:
        raise ValueError(f"not a fixed-length interval: {interval!r}")
    return count * UNIT_MICROS[unit]


@dataclass(frozen=True)
class Slots:
    """Measured slots: some hours each, or some parts of an hour each; hours that
    are much busier than the rest (hour number -> parts) are cut on their own."""

    hours: int = 1
    parts: int = 1
    hot: tuple[tuple[int, int], ...] = ()

    def cut_hours(self) -> dict[int, int]:
        """Parts of the hot hours and of all hours that would share a slot with one."""
        cut: dict[int, int] = {}
        for hour, parts in self.hot:
            first = hour - hour % self.hours
            for other in range(first, first + self.hours):
                cut.setdefault(other, self.parts)
            cut[hour] = max(cut[hour], parts)
        return cut

    def also_before(self, seconds: int) -> Slots:
        """The same with the hours ``seconds`` before the hot ones cut as well."""
        hot = dict(self.hot)
        for hour, parts in self.hot:
            for back in (seconds // 3600, -(-seconds // 3600)):
                hot[hour - back] = max(parts, hot.get(hour - back, 1))
        return replace(self, hot=tuple(sorted(hot.items())))


@dataclass(frozen=True)
class Series:
    """Which columns make up a series, and how it is cut.

    ``time`` plus ``tiebreak`` must order the rows of a key completely. A slot is
    ``slot_micros`` long; when left out, ``slots`` are measured from the data.
    """

    keys: tuple[str, ...] = ("symbol",)
    time: str = "timestamp"
    tiebreak: tuple[str, ...] = ()
    slot_micros: int | None = None
    block_rows: int = BLOCK_ROWS
    slots: Slots | None = None

    @classmethod
    def of(cls, df: DataFrame, series: Series | None = None) -> Series:
        """The given layout, or the default: per symbol where there is one."""
        if series is not None:
            return series
        return cls(keys=("symbol",) if "symbol" in df.columns else ())

    @classmethod
    def of_bars(cls, interval: str, **other) -> Series:
        """Layout for bars no closer than ``interval``.

        Bars are unique per (key, timestamp), so a slot of SLOT_ROWS intervals
        holds at most SLOT_ROWS rows and nothing has to be measured.
        """
        return cls(slot_micros=SLOT_ROWS * interval_micros(interval), **other)

    def with_keys(self, *keys: str) -> Series:
        return replace(self, keys=keys)

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tiebreak]

    def slot_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, SLOT).orderBy(*self.order)

    def slots_in_order(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(SLOT)


def _micros(time: str) -> str:
    return f"unix_micros(CAST(`{time}` AS TIMESTAMP))"


def _hour(micros: str) -> str:
    return f"(({micros} - pmod({micros}, {HOUR_MICROS})) div {HOUR_MICROS})"


def measure_slots(df: DataFrame, series: Series, rows: int = SLOT_ROWS) -> Slots:
    """Slots of about ``rows`` rows of the busiest key.

    One pass over the key and time columns, aggregated on the map side. What comes
    back is one number per hour of the time span, whatever the number of rows.
    """
    hour = F.expr(_hour(_micros(series.time)))
    busiest = (
        df.where(F.col(series.time).isNotNull())
        .groupBy(*series.keys, hour.alias("_hour"))
        .agg(F.count("*").alias(COUNT))
        .groupBy("_hour")
        .agg(F.max(COUNT).alias(COUNT))
        .collect()
    )
    usual = max(1, sum(r[COUNT] for r in busiest) // max(1, len(busiest)))
    limit = HOT_HOUR * max(usual, rows)
    hot = sorted((r["_hour"], min(MOST_PARTS, -(-r[COUNT] // rows))) for r in busiest if r[COUNT] > limit)
    return Slots(max(1, rows // usual), min(MOST_PARTS, -(-usual // rows)), tuple(hot))


def measured(df: DataFrame, series: Series) -> Series:
    """The series with its slots known."""
    if series.slot_micros is not None or series.slots is not None:
        return series
    return replace(series, slots=measure_slots(df, series))


def with_slots(df: DataFrame, series: Series) -> tuple[DataFrame, Series]:
    """Add the slot column; the returned series has its slots known."""
    series = measured(df, series)
    unknown = F.col(series.time).isNull()
    for key in series.keys:
        unknown = unknown | F.col(key).isNull()
    refused = F.raise_error(F.lit("series key and time must not be null")).cast("bigint")
    micros = _micros(series.time)
    if series.slot_micros is not None:
        slot = F.expr(f"{micros} div {series.slot_micros}")
        return df.withColumn(SLOT, F.when(unknown, refused).otherwise(slot)), series

    hour, slots = _hour(micros), series.slots

    def part(parts: str) -> str:
        offset = f"pmod({micros}, {HOUR_MICROS}) * {parts} div {HOUR_MICROS}"
        return f"({hour} * {MOST_PARTS} + {offset})"

    together = f"(({hour} - pmod({hour}, {slots.hours})) * {MOST_PARTS})"
    usual = part(str(slots.parts)) if slots.parts > 1 else together
    if not slots.hot:
        return df.withColumn(SLOT, F.when(unknown, refused).otherwise(F.expr(usual))), series
    # At most one row per hour of the time span, as a local table whose size is known.
    cut = slots.cut_hours()
    table = pa.table({"_hour": pa.array(cut.keys(), "int64"), "_parts": pa.array(cut.values(), "int64")})
    known = df.sparkSession.createDataFrame(table)
    slot = F.expr(f"CASE WHEN _parts IS NULL THEN {usual} ELSE {part('_parts')} END")
    joined = df.withColumn("_hour", F.expr(hour)).join(known, "_hour", "left")
    slotted = joined.withColumn(SLOT, F.when(unknown, refused).otherwise(slot))
    return slotted.drop("_hour", "_parts"), series


def rows_before(slots: DataFrame, series: Series) -> DataFrame:
    """Slot table with COUNT -> the same with BEFORE, the rows in earlier slots."""
    earlier = series.slots_in_order().rowsBetween(Window.unboundedPreceding, -1)
    return slots.withColumn(BEFORE, F.coalesce(F.sum(COUNT).over(earlier), F.lit(0)))


def join_slots(slotted: DataFrame, slots: DataFrame, series: Series) -> DataFrame:
    """Bring slot-table columns to the rows.

    The join keys are also the partitioning of the slot windows that follow, so
    the rows are exchanged once for both. Which join it is, is the optimiser's
    choice by the size of the slot table.
    """
    return slotted.join(slots, [*series.keys, SLOT], "left")


def number_rows(df: DataFrame, series: Series | None = None) -> DataFrame:
    """Add POS, the zero-based position of each row in its series.

    Rows that have it already are left as they are: operators applied one after
    the other to numbered rows keep the column and do not count again.
    """
    if POS in df.columns:
        return df
    series = Series.of(df, series)
    slotted, series = with_slots(df, series)
    slots = slotted.groupBy(*series.keys, SLOT).agg(F.count("*").alias(COUNT))
    rows = join_slots(slotted, rows_before(slots, series).drop(COUNT), series)
    return position_in_slots(rows, series)


def position_in_slots(rows: DataFrame, series: Series) -> DataFrame:
    number = F.row_number().over(series.slot_window())
    return rows.withColumn(POS, F.col(BEFORE) + number - 1).drop(SLOT, BEFORE)


def in_blocks(
    numbered: DataFrame, series: Series, lookback: int = 0, lookahead: int = 0
) -> tuple[DataFrame, int]:
    """Add BLOCK, repeating rows that neighbouring blocks need to look at.

    A row at position p is seen by the blocks of positions p - lookahead to
    p + lookback. Blocks are kept at least 8 times as long as the overlap, so at
    most an eighth of the rows is copied. The exchange the windows need is placed
    here, so that inputs derived for them later do not travel.
    """
    size = max(series.block_rows, 8 * (lookback + lookahead))
    pos = f"`{POS}`"
    blocks = (
        f"explode(sequence(greatest({pos} - {lookahead}, 0) div {size},"
        f" ({pos} + {lookback}) div {size}))"
        if lookback + lookahead
        else f"{pos} div {size}"
    )
    placed = numbered.withColumn(BLOCK, F.expr(blocks))
    return placed.repartition(*[F.col(k) for k in series.keys], F.col(BLOCK)), size


def own_rows(blocked: DataFrame, size: int, given: Sequence[str]) -> DataFrame:
    """Drop the copies, and the helper columns (``_name``) added to the given ones."""
    own = F.col(BLOCK) == F.expr(f"`{POS}` div {size}")
    helpers = [c for c in blocked.columns if c.startswith("_") and c not in given]
    return blocked.where(own).drop(*helpers)


@dataclass(frozen=True)
class Frames:
    """Window frames inside blocks, handed to the indicator formulas."""

    series: Series
    order: tuple[str, ...] = (POS,)

    def window(self, *finer: str) -> WindowSpec:
        order = [c for c in self.order if c not in finer]
        return Window.partitionBy(*self.series.keys, BLOCK, *finer).orderBy(*order)

    def last(self, rows: int) -> WindowSpec:
        return self.window().rowsBetween(1 - rows, 0)

    def earlier(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, -1)

    def lag(self, column: Column, rows: int = 1) -> Column:
        return F.lag(column, rows).over(self.window())

    def lead(self, column: Column, rows: int = 1) -> Column:
        return F.lead(column, rows).over(self.window())

    @property
    def first_row(self) -> Column:
        return F.col(POS) == 0


def over_blocks(
    df: DataFrame,
    levels,
    series: Series | None = None,
    lookback: int = 0,
    lookahead: int = 0,
) -> DataFrame:
    """Add window columns level by level: ``levels(frames)`` is a list of dicts
    name -> Column, each of which may use the columns of the dicts before it."""
    series = Series.of(df, series)
    blocked, size = in_blocks(number_rows(df, series), series, lookback, lookahead)
    for level in levels(Frames(series)):
        blocked = blocked.withColumns(level)
    return own_rows(blocked, size, df.columns)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
