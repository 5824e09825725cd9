"""Landed payload files as a data source with offsets of its own, for batches and streams.

A file is known by when it was last changed and its path; that is its place in the order
of landing, and a stream's offset is the place of the last file it has taken. Files that
changed in the last `settle` seconds are left for later: they may still be written, and
another of an earlier place may still appear. A file is one row, read whole.

Files are listed and opened through Arrow's file systems, so a folder is named by a path
or by a URI that those know (`file:`, `hdfs:`, `s3:`, `gs:`), on the driver and in tasks.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import re
import time
from collections.abc import Iterator

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tsquant.operators.cleansing import clean_bars
from tsquant.sources.payloads import EXTENSION, parse_chart_payloads
from tsquant.sources.upkeep import upsert_table

SCHEMA = "path string, changed timestamp, size bigint, requested_symbol string, payload string"
#: Bytes that a task reads, about; a larger file is a task of its own.
TASK_BYTES = 64 << 20
Place = tuple[int, str]  # microseconds, path


class Files(InputPartition):
    """Files of one task: path, microseconds, size."""

    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(tuple(files))
        self.files = files


class Landing:
    """The folder that options name, with what both readers need."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.glob = options.get("glob", "*.json")
        self.settle = float(options.get("settle", "0"))
        self.task_bytes = int(options.get("taskbytes", options.get("taskBytes", TASK_BYTES)))

    def opened(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.folder or self.folder.startswith("file:"):
            uri = re.sub(r"^file:/+", "file:///", self.folder)
            return fs.FileSystem.from_uri(uri)
        return fs.LocalFileSystem(), self.folder

    def files(self) -> list[tuple[Place, int]]:
        """Settled files in the order of landing, with their sizes."""
        system, folder = self.opened()
        until = int((time.time() - self.settle) * 1e6)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
        rows = [
            ((info.mtime_ns // 1000, info.path), info.size)
            for info in found
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.glob) and info.base_name[0] not in "._"
        ]
        return sorted(row for row in rows if row[0][0] <= until)

    def tasks(self, files: list[tuple[Place, int]]) -> list[Files]:
        """Neighbouring files together up to the bytes of a task."""
        out: list[list[tuple[str, int, int]]] = []
        held = 0
        for (changed, path), size in files:
            if not out or held + size > self.task_bytes:
                out.append([])
                held = 0
            out[-1].append((path, changed, size))
            held += size
        return [Files(part) for part in out]

    def rows(self, part: Files | None) -> Iterator[tuple]:
        """What the files of a task hold; a source without any is asked for none."""
        system, _ = self.opened()
        for path, changed, size in part.files if part else ():
            with system.open_input_stream(path) as stream:  # unpacked by its extension
                text = stream.read().decode("utf-8", "replace")
            symbol = re.sub(EXTENSION, "", path.rsplit("/", 1)[-1])
            at = dt.datetime.fromtimestamp(changed / 1e6, dt.timezone.utc)
            yield path, at, size, symbol, text


class LandingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.landing = Landing(options)

    def partitions(self) -> list[Files]:
        return self.landing.tasks(self.landing.files())

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.landing.rows(partition)


class LandingStreamReader(DataSourceStreamReader):
    """Takes files behind the offset, `files` of them in a batch at most (all by default).

    With a limit use a trigger that goes on: `availableNow` ends with the first offset
    it is told.
    """

    def __init__(self, options: dict[str, str]):
        self.landing = Landing(options)
        self.most = int(options.get("files", "0"))
        self.at: Place = (-1, "")

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        behind = [place for place, _ in self.landing.files() if place > self.at]
        if behind:
            self.at = behind[min(self.most, len(behind)) - 1] if self.most else behind[-1]
        return {"changed": self.at[0], "path": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = ((x["changed"], x["path"]) for x in (start, end))
        # After a restart the reader is new; the batches asked for tell where it is.
        self.at = max(self.at, last)
        return self.landing.tasks([f for f in self.landing.files() if first < f[0] <= last])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.landing.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class LandedPayloads(DataSource):
    """Options: path; glob (`*.json`); settle (seconds, 0); files (of a batch); taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "landed_payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> LandingReader:
        return LandingReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> LandingStreamReader:
        return LandingStreamReader(dict(self.options))


def read_landed(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """Landed payloads with their symbol, parsed as `read_chart_payloads` does, as a table or as a stream."""
    spark.dataSource.register(LandedPayloads)
    reader = (spark.readStream if stream else spark.read).format("landed_payloads")
    rows = reader.options(**{k: str(v) for k, v in options.items()}).option("path", path).load()
    return parse_chart_payloads(rows.select("requested_symbol", "payload", "path", "changed")).drop("payload")


def stream_payloads(
    spark: SparkSession, landing: str, bars_table: str, checkpoint: str, trigger: dict | None = None, **options: str
) -> StreamingQuery:
    """Start a query that cleans landed payloads into the bars table, batch by batch.

    A batch is an upsert, so one that is run again changes nothing. A batch without a
    valid bar writes nothing and does not stop the stream.
    """

    def process(batch: DataFrame, number: int) -> None:
        bars = clean_bars(batch.drop("path", "changed"), F.col("requested_symbol")).persist()
        try:
            if not bars.isEmpty():
                upsert_table(bars, bars_table)
        finally:
            bars.unpersist()

    payloads = read_landed(spark, landing, stream=True, **options)
    writer = payloads.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
