"""The data source of landed payloads: batch, stream, restarts."""

import json
import os

import pytest
from test_cleansing import AT, BROKEN, EMPTY, GOOD, UNNAMED, payload

from tsquant.sources.landing import Landing, LandingStreamReader, read_landed, stream_payloads
from tsquant.sources.payloads import read_chart_payloads
from tsquant.sources.tables import read_bars


def put(folder, name, text, changed):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (changed, changed))


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_batch_is_what_the_files_hold(spark, tmp_path):
    folder = tmp_path / "landed"
    for at, (name, text) in enumerate({"BRK.B.json": GOOD, "x.json": BROKEN, "MC.PA.json": UNNAMED, "_skip.json": GOOD, "note.txt": "no"}.items()):
        put(folder, name, text, 1000 + at)
    found = read_landed(spark, str(folder), taskBytes=10)
    plain = read_chart_payloads(spark, [str(folder / n) for n in ("BRK.B.json", "x.json", "MC.PA.json")], per_file=True)
    assert rows(found.select(*plain.columns)) == rows(plain)
    assert found.rdd.getNumPartitions() == 3
    assert read_landed(spark, f"file://{folder}").count() == 3 and read_landed(spark, str(tmp_path / "none")).count() == 0


def test_offsets_are_places_in_the_order_of_landing(tmp_path):
    folder = tmp_path / "landed"
    for name, at in (("b.json", 5), ("a.json", 5), ("c.json", 3)):
        put(folder, name, GOOD, at)
    reader = LandingStreamReader({"path": str(folder), "files": "2"})
    one = reader.latestOffset()
    assert one["path"].endswith("a.json") and one["changed"] == 5_000_000
    names = lambda a, b: [os.path.basename(f[0]) for p in reader.partitions(a, b) for f in p.files]
    assert names(reader.initialOffset(), one) == ["c.json", "a.json"]
    two = reader.latestOffset()
    assert names(one, two) == ["b.json"] and reader.latestOffset() == two and names(two, two) == []
    # A new reader, as after a restart, goes on behind the batch it is asked for.
    again = LandingStreamReader({"path": str(folder), "files": "2"})
    assert [os.path.basename(f[0]) for p in again.partitions(one, two) for f in p.files] == ["b.json"]
    assert again.latestOffset() == two
    assert Landing({"path": str(folder), "settle": "1e10"}).files() == []


@pytest.mark.parametrize("files", [1, 0])
def test_a_stream_neither_skips_nor_repeats(spark, tmp_path, files):
    folder, table, check = tmp_path / "landed", str(tmp_path / "bars"), str(tmp_path / "check")
    texts = [payload([AT + 86_400 * i, AT + 86_400 * i + 3600], symbol=s) for i, s in enumerate("ABAC")]

    def run():
        if files:
            query = stream_payloads(spark, str(folder), table, check, {"processingTime": "0 seconds"}, files=files)
            query.processAllAvailable()
            query.stop()
        else:
            stream_payloads(spark, str(folder), table, check).awaitTermination()
        return rows(read_bars(spark, table))

    put(folder, "0.json", texts[0], 1000)
    put(folder, "1.json", texts[1], 1001)
    put(folder, "bad.json", BROKEN, 1002)
    first = run()
    assert len(first) == 4 and run() == first
    put(folder, "2.json", texts[2], 1003)
    put(folder, "3.json", texts[3], 1004)
    put(folder, "4.json", EMPTY, 1005)
    whole = run()
    # The last batch again: the driver was lost before it was marked as done.
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run() == whole
    batch = tmp_path / "batch"
    for i, text in enumerate(texts):
        put(batch, f"{i}.json", text, 1000)
    from pyspark.sql import functions as F

    from tsquant.operators.cleansing import clean_bars
    from tsquant.schemas import BARS_TABLE

    assert whole == rows(clean_bars(read_landed(spark, str(batch)), F.col("requested_symbol")).select(*BARS_TABLE.fieldNames()))
    assert json.loads(GOOD)
