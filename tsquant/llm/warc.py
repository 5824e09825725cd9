"""WARC archives: pages written as capture transactions, archives read back as captures.

Every page becomes three records that name each other: the answer (`response`, or
`revisit` where another capture holds the same payload), the `request` and the
`metadata`, the last two with WARC-Concurrent-To. Archives are written by the text
sink with the record separator as its line end, so any task can write any share of
them, and an attempt that is run again replaces its own file. Reading cuts every file
into records by Content-Length and joins the records of a transaction through their
concurrent-to identifiers into one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsquant.llm.arrow import map_batches
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

CRLF = "\r\n"
END = CRLF + CRLF
#: Captures in one archive file at most.
FILE_CAPTURES = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# The digits of base 32 in two notations.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: A record as read: `text` is the block of a request or metadata record, the last five are of an answer.
RECORD = (
    "kind string, id string, concurrent_to string, url string, date string, text string, refers_to string, "
    "payload_digest string, payload_bytes long, intact boolean, payload binary"
)
ANSWERS = ("response", "revisit", "resource")


def base32_sha1(data: Column) -> Column:
    """SHA-1 of bytes in base 32; its 160 bits are 32 digits, four from every 20 bits."""
    digest = F.sha1(data)

    def four(i: Column) -> Column:
        part = F.substr(digest, i * 5 + 1, F.lit(5))
        return F.translate(F.lpad(F.conv(part, 16, 32), 4, "0"), DIGITS, LETTERS)

    return F.concat_ws("", *[four(F.lit(i)) for i in range(8)])


def _named(name: Column) -> Column:
    """A urn:uuid made from a name, the same whenever the row is computed again."""
    digest = F.sha1(name.cast("binary"))
    cut = [F.substr(digest, F.lit(at), F.lit(size)) for at, size in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", cut[0], cut[1], F.concat(F.lit("5"), cut[2]), F.concat(F.lit("8"), cut[3]), cut[4]), F.lit(">"))


def _record(fields: dict[str, Column | str | None], block: Column) -> Column:
    """Bytes of a record without the empty lines that end it; null fields are left out."""
    lines = [
        F.concat(F.lit(f"{CRLF}{name}: "), value if isinstance(value, Column) else F.lit(value))
        for name, value in fields.items()
    ]
    size = F.concat(F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    head = F.concat(F.lit("WARC/1.1"), *[F.coalesce(line, F.lit("")) for line in lines], size)
    return F.concat(head.cast("binary"), block)


def captures(
    pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = 0
) -> DataFrame:
    """Decides for every capture whether it is a response or revisits another.

    Returns id, url, payload (bytes), bytes, digest, record_id, type, refers_to (the
    id of the response) and refers_record. Of captures with equal payloads of at
    least `least` bytes the one with the largest id is the response, by url among
    equal ids; null ids come before all others, null urls too. Rows equal in id, url
    and payload are captures of their own, of which the first is the response and the
    others revisit it. A null payload is empty.
    """
    payload = F.coalesce(pages[payload_column].cast("binary"), F.lit(b""))
    rows = pages.select(
        pages[id_column].alias("id"), F.regexp_replace(pages[url_column], r"[\x00-\x20\x7f]", "").alias("url"),
        payload.alias("payload"),
    )
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    text = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("id", "digest", "url")]
    rows = _repeats_told(rows)
    copy = F.when(F.col("copy") > 1, F.col("copy").cast("string"))
    rows = rows.withColumn("record_id", _named(F.concat_ws(" ", F.lit("answer"), *text, copy)))
    # Small rows alone decide; payloads travel once, to their decision.
    keys = rows.select("digest", F.struct("id", "url", "record_id").alias("c"), "bytes")
    keys = keys.where((F.col("bytes") >= least) & (rows["copy"] == 1))
    holder = keys.groupBy("digest").agg(F.max("c").alias("c"))
    rows = rows.join(
        holder.select("digest", F.col("c.id").alias("holder_id"), F.col("c.record_id").alias("holder")), "digest", "left"
    )
    again = F.col("holder").isNotNull() & (F.col("holder") != F.col("record_id"))
    return rows.select(
        "id", "url", "payload", "bytes", "digest", "record_id",
        F.when(again, "revisit").otherwise("response").alias("type"),
        F.when(again, F.col("holder_id")).alias("refers_to"),
        F.when(again, F.col("holder")).alias("refers_record"),
    )


def _repeats_told(rows: DataFrame) -> DataFrame:
    """Adds `copy`: 1, and 2 and so on for further rows equal in id, url and digest.

    Ids, urls and digests are counted first. Where nothing repeats, as is usual, no
    payload moves; else only rows that repeat are gathered, one for all of its copies.
    """
    key = ["id", "url", "digest"]
    many = rows.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("many")).where("many > 1")
    if many.isEmpty():
        return rows.withColumn("copy", F.lit(1))
    many = many.toDF(*[f"_{c}" for c in key], "many")
    met = rows.join(many, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]), "left")
    once = met.where("many IS NULL").select(*rows.columns, F.lit(1).alias("copy"))
    again = met.where("many IS NOT NULL").dropDuplicates(key)
    return once.union(again.select(*rows.columns, F.explode(F.sequence(F.lit(1), "many")).alias("copy")))


def write_warc(decided: DataFrame, path: str, *, date: str = "2025-01-01T00:00:00Z", file_captures: int = FILE_CAPTURES) -> None:
    """Writes the captures as archives `part-*.txt.gz` of whole records under a new path.

    Every capture has a response or revisit, a request and a metadata record; the last
    two name the first. A revisit has the HTTP head of its answer and no payload. Ids
    stand in the metadata, so they come back whatever their type's text is.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.regexp_extract(url, "^[a-z]+://([^/]*)", 1)
    resource = F.regexp_replace(url, "^[a-z]+://[^/]*|#.*$", "")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(END),
    ).cast("binary")
    revisit = F.col("type") == "revisit"
    common = {"WARC-Date": date, "WARC-Target-URI": F.when(url != "", url)}
    answer = _record(
        {
            "WARC-Type": F.col("type"), "WARC-Record-ID": F.col("record_id"), **common,
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
            "WARC-Refers-To": F.col("refers_record"), "WARC-Profile": F.when(revisit, F.lit(PROFILE)),
            "Content-Type": "application/http; msgtype=response",
        },
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    ask = F.concat(
        F.lit("GET "), F.when(resource == "", "/").otherwise(resource), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(END)
    )
    request = _record(
        {
            "WARC-Type": "request", "WARC-Record-ID": _named(F.concat(F.lit("request"), F.col("record_id"))),
            **common, "WARC-Concurrent-To": F.col("record_id"), "Content-Type": "application/http; msgtype=request",
        },
        ask.cast("binary"),
    )
    facts = F.concat(
        F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit("")),
        F.coalesce(F.concat(F.lit("refers-to-page: "), F.col("refers_to").cast("string"), F.lit(CRLF)), F.lit("")),
    )
    metadata = _record(
        {
            "WARC-Type": "metadata", "WARC-Record-ID": _named(F.concat(F.lit("metadata"), F.col("record_id"))),
            **common, "WARC-Concurrent-To": F.col("record_id"), "Content-Type": "application/warc-fields",
        },
        facts.cast("binary"),
    )
    # A row of the sink holds the three records; the sink ends it with the fourth pair of line ends.
    whole = F.concat(answer, F.lit(END.encode()), request, F.lit(END.encode()), metadata)
    # Bytes pass through the sink unchanged; it is the only reader of this string.
    lines = decided.select(whole.cast("string").alias("value"))
    sink = lines.write.option("compression", "gzip").option("lineSep", END)
    sink.option("maxRecordsPerFile", file_captures).text(path)


Record = tuple[dict[str, str], bytes]


def records_of(stream: BinaryIO) -> Iterator[Record]:
    """Headers, by names in lower case, and block of every record of an unpacked archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {stream.tell() - len(line)}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != END.encode():
            raise ValueError(f"the WARC record before byte {stream.tell()} is cut short")
        yield headers, block


def fields_of(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """The values of `RECORD` for one record."""
    kind = headers.get("warc-type")
    common = kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to")
    common += headers.get("warc-target-uri"), headers.get("warc-date")
    if kind not in ANSWERS:
        return *common, block.decode("utf-8", "replace"), None, None, None, None, None
    head, payload = b"", block
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(END.encode())
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
        return *common, None, headers.get("warc-refers-to"), digest, int(length[1]) if length else None, None, None
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return *common, None, None, own, len(payload), digest in (None, own), payload if payloads else None


def read_records(spark: SparkSession, path: str, *, payloads: bool = True, glob: str | None = None) -> DataFrame:
    """Records of all archives under a path, with the columns of `RECORD`.

    Files that end in .gz are unpacked, of any number of members. `payload_bytes` and
    `payload_digest` are taken from the payload itself where there is one, and
    `intact` says whether the digest of the header agrees; a revisit has those of its
    header and of its HTTP head. A file is read by one task, record by record; its
    packed bytes are one cell, so it must be smaller than 2 GB. `glob` names the files
    that are meant (`*.warc.gz`), else all are whose names do not start with `_` or
    `.`; that there is none is an error.
    """
    schema = _parse_datatype_string(RECORD)
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), types)], schema=types)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                packed = pa.BufferReader(content.as_buffer())
                stream = gzip.GzipFile(fileobj=packed) if name.as_py().endswith(".gz") else packed
                held, size = [], 0
                for headers, block in records_of(io.BufferedReader(stream, 1 << 20)):
                    held.append(fields_of(headers, block, payloads))
                    size += len(block)
                    if size > 4 << 20 or len(held) == 4096:
                        yield out(held)
                        held, size = [], 0
                if held:
                    yield out(held)

    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    if files.select("path").isEmpty():
        raise ValueError(f"no archive {glob or ''} under {path}")
    return map_batches(files, run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, answer, request, metadata.

    Request and metadata records meet the answer that they are concurrent to, in one
    exchange by its id. `answer` is (type, url, date, payload_bytes, payload_digest,
    refers_to, intact, payload), `request` and `metadata` are (id, text); each is null
    where the archives lack it, so an orphan request makes a row without an answer.
    Of several records of one role the least by value is taken, so a record that is
    repeated counts once. Records of other types are left out.
    """
    kind = F.col("kind")
    answer = F.struct(
        kind.alias("type"), "url", "date", "payload_bytes", "payload_digest", "refers_to", "intact", "payload"
    )
    side = F.struct("id", "text")
    rows = records.where(kind.isin(*ANSWERS, "request", "metadata")).select(
        F.when(kind.isin(*ANSWERS), F.col("id")).otherwise(F.coalesce("concurrent_to", "id")).alias("capture_id"),
        F.when(kind.isin(*ANSWERS), answer).alias("answer"),
        F.when(kind == "request", side).alias("request"),
        F.when(kind == "metadata", side).alias("metadata"),
    )
    return rows.groupBy("capture_id").agg(*[F.min(c).alias(c) for c in ("answer", "request", "metadata")])


def field(fields: Column, name: str) -> Column:
    """A value of a warc-fields block; null where it is missing."""
    value = F.regexp_extract(fields, rf"(?m)^{name}: *([^\r\n]*)", 1)
    return F.when(value != "", value)
