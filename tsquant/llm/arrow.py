"""Arrow helpers for steps that run Python inside tasks."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

#: Rows of an Arrow batch, where the session has Spark's default of 10,000: rows are long
#: here, and batches of both sides of a task stand in memory at once.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Characters of text that a task turns into results before it hands them on.
SLICE_CHARS = 1 << 20


def map_batches(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """`rows.mapInArrow(run, schema)` in batches that suit long rows; a session's own size stays."""
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING) == "10000":
        conf.set(BATCH_SETTING, BATCH_ROWS)
    return rows.mapInArrow(run, schema)


def refuse_repeats(names: list[str]) -> None:
    """Raises where an operator would return two columns of one name."""
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns {twice} would be there twice; rename those to be kept")


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS
) -> Iterator[pa.RecordBatch]:
    """Cuts batches by the size of their texts; a longer single row is its own slice."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > chars:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps between tasks: the state of one operator at a time.

    Workers are used again by other operators, whose memory would add up otherwise.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


class TwoGenerations:
    """A memo of bounded size: entries that are not asked for again leave it.

    New entries go to the young half; when that is full it becomes the old half and
    the old half is dropped. What is dropped is computed again when needed, so the
    bound changes no result.
    """

    def __init__(self, make: Callable[[list], list], half: int):
        self.make, self.half = make, half
        self.young: dict = {}
        self.old: dict = {}

    def of(self, keys: list) -> dict:
        """A mapping that holds all the keys given, for this call only."""
        young, old = self.young, self.old
        missing = []
        for key in set(keys):
            if key not in young:
                value = old.get(key)
                if value is None:
                    missing.append(key)
                else:
                    young[key] = value
        if missing:
            young.update(zip(missing, self.make(missing), strict=True))
        if len(young) > self.half:
            self.old, self.young = young, {}
        return young
