"""Files, tables and the two jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from support import BARS, START, plan_of, random_bars
from test_cleansing import BROKEN, EMPTY, GOOD, UNNAMED

from tsquant.functions.work import work_dir
from tsquant.operators import bars as B
from tsquant.operators import indicators as I
from tsquant.operators import reshape as R
from tsquant.plans.jobs import compute_indicators, ingest_payloads
from tsquant.schemas import CORRUPT
from tsquant.sources import payloads as P
from tsquant.sources import tables as S


@pytest.fixture
def bars(spark):
    rows = random_bars({"ACME": 300, "OTHR": 200, "we/ird=": 50}, step=7200)
    return B.with_bucket(spark.createDataFrame(rows, BARS))


def same(a, b):
    return sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(
        map(tuple, b.select(sorted(b.columns)).collect())
    )


def test_round_trip(spark, tmp_path, bars):
    path = str(tmp_path / "bars")
    assert S.append_table(bars, path) is True
    assert same(S.read_bars(spark, path), bars)
    assert S.append_table(bars, path) is True
    assert S.read_bars(spark, path).count() == 2 * bars.count()


def test_empty_append_says_so(spark, tmp_path, bars):
    path = str(tmp_path / "bars")
    S.append_table(bars, path)
    assert S.append_table(bars.limit(0), path) is False
    assert S.read_bars(spark, path).count() == bars.count()


def test_slices_are_pruned(spark, tmp_path, bars):
    path = str(tmp_path / "bars")
    S.append_table(bars, path)
    found = S.read_bars(spark, path, ["ACME", "we/ird="], "2025-02", "2025-03")
    wanted = bars.where("symbol <> 'OTHR' AND date_bucket BETWEEN '2025-02' AND '2025-03'")
    assert wanted.count() > 0 and same(found, wanted)
    plan = plan_of(found.select("symbol", "close"))
    partitions = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    schema = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "2025-02" in partitions and "2025-03" in partitions and "In(symbol" in pushed
    assert "volume" not in schema and "open" not in schema


def test_later_loads_replace_earlier_ones(spark, tmp_path, bars):
    path = str(tmp_path / "bars")
    S.append_table(bars, path, stamp=True)
    S.append_table(bars.where("symbol = 'OTHR'").withColumn("volume", F.lit(-5).cast("bigint")), path, stamp=True)
    found = S.read_bars(spark, path, newest_load=True)
    assert found.count() == bars.count()
    assert found.where("volume = -5").count() == bars.where("symbol = 'OTHR'").count()


def test_indicator_table(spark, tmp_path, bars):
    stored, records = str(tmp_path / "bars"), str(tmp_path / "records")
    S.append_table(bars, stored)
    assert compute_indicators(spark, stored, records) is True
    found = S.read_indicators(spark, records)
    assert found.count() == 7 * bars.count()
    direct = R.to_indicator_records(I.enrich_all(bars))
    flat = [F.explode("values").alias("k", "v")]
    keys = ["symbol", "timestamp", "indicator_type"]
    a = sorted(map(tuple, found.select(*keys, *flat).where("v IS NOT NULL").collect()))
    b = sorted(map(tuple, direct.select(*keys, *flat).where("v IS NOT NULL").collect()))
    assert len(a) == len(b)
    assert all(x[:4] == y[:4] and abs(x[4] - y[4]) < 1e-9 for x, y in zip(a, b, strict=True))
    some = S.read_indicators(spark, records, ["OTHR"], types=["RSI"])
    assert some.count() == 200 and some.select("indicator_type").distinct().count() == 1


def test_ingest_files_of_many_symbols(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    for name, text in {"ACME": GOOD, "OTHR": UNNAMED, "BAD": BROKEN, "NONE": EMPTY}.items():
        (landed / f"{name}.json").write_text(json.dumps(json.loads(text), indent=1) if text != BROKEN else text)
    table = str(tmp_path / "bars")
    counts = ingest_payloads(spark, str(landed), table, per_file=True)
    assert counts == {"payloads": 4, "corrupt": 1, "timed": 2}
    found = S.read_bars(spark, table)
    assert sorted(r["symbol"] for r in found.collect()) == ["ACME", "OTHR"]


@pytest.mark.parametrize("text, reason", [(BROKEN, "every record is corrupt"), (EMPTY, "no timestamps")])
def test_failed_load_raises_and_writes_nothing(spark, tmp_path, text, reason):
    (tmp_path / "X.json").write_text(text)
    table = str(tmp_path / "bars")
    with pytest.raises(ValueError, match=reason):
        ingest_payloads(spark, str(tmp_path / "X.json"), table)
    assert not list((tmp_path / "bars").rglob("*.parquet"))


def test_one_document_per_line(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join([GOOD, BROKEN, UNNAMED]))
    found = P.read_chart_payloads(spark, str(tmp_path / "lines.json")).collect()
    assert [r[CORRUPT] is None for r in found] == [True, False, True]
    assert {r["requested_symbol"] for r in found} == {"lines"}


def test_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Symbol,Price,High,Low,Timestamp\nIBM,261.28,261.94,257.91,2025-02-14 15:30:00\n")
    row = P.read_quote_csv(spark, str(tmp_path / "q.csv")).first()
    assert tuple(row) == ("IBM", 261.28, 261.94, 257.91, dt.datetime(2025, 2, 14, 15, 30))


def test_retention(spark):
    rows = [(START - dt.timedelta(days=d, seconds=s),) for d in (0, 30) for s in (0, 1)]
    df = spark.createDataFrame(rows, "timestamp timestamp")
    assert B.apply_retention(df, START).count() == 3
    assert B.apply_retention(df, "2025-01-01 10:00:00", 1).count() == 2


def test_work_folder_is_the_shared_one(spark):
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/x-")


def test_bars_of_ticks(spark):
    rows = [
        ("A", START, 5.0, 1, 2),
        ("A", START, 4.0, 1, 1),
        ("A", START + dt.timedelta(seconds=59), 9.0, 2, 3),
        ("A", START + dt.timedelta(seconds=59), 8.0, 2, 4),
        ("A", START + dt.timedelta(seconds=60), 1.0, 7, 5),
    ]
    ticks = spark.createDataFrame(rows, "symbol string, timestamp timestamp, price double, volume bigint, id int")
    bars = B.bars_from_ticks(ticks, "minute", tiebreak=("id",)).orderBy("timestamp").collect()
    assert [tuple(b)[3:] for b in bars] == [(4.0, 9.0, 4.0, 8.0, 6), (1.0, 1.0, 1.0, 1.0, 7)]
    assert [b["timestamp"].minute for b in bars] == [0, 1]
    quarter = B.bars_from_ticks(ticks, "15 minutes", tiebreak=("id",))
    assert quarter.count() == 1 and quarter.first()["volume"] == 13
    assert B.resample_bars(B.bars_from_ticks(ticks, tiebreak=("id",)), "week").first()["close"] == 1.0


def test_symbols_stay_as_they_occur(spark, tmp_path):
    """Dots and leading zeros, from file names and from partitions."""
    symbols = ["BRK.A", "BRK.B", "MC.PA", "0700", "0005", "ACME"]
    payload = '{"chart":{"result":[],"error":null}}'
    for symbol in symbols:
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / f"{symbol}.json").write_text(payload)
        part = tmp_path / "parts" / f"requested_symbol={symbol}"
        part.mkdir(parents=True)
        (part / "part-0.txt").write_text(payload)
    for folder in ("files", "parts"):
        found = P.read_chart_payloads(spark, str(tmp_path / folder), per_file=True)
        assert sorted(r.requested_symbol for r in found.collect()) == sorted(symbols)
    numbers = spark.createDataFrame([("0700", payload), ("0005", payload)], "requested_symbol string, payload string")
    numbers.write.partitionBy("requested_symbol").text(str(tmp_path / "numbers"))
    found = P.read_chart_payloads(spark, str(tmp_path / "numbers"))
    assert sorted(r.requested_symbol for r in found.collect()) == ["0005", "0700"]


def test_other_formats(spark, tmp_path):
    path = str(tmp_path / "orc")
    bars = B.with_bucket(spark.createDataFrame(random_bars({"A": 20}), BARS))
    assert S.append_table(bars, path, format="orc", options={"compression": "zlib"})
    found = S.read_bars(spark, path, ["A"], format="orc")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, bars.collect()))


def test_bad_quote_lines_are_told(spark, tmp_path):
    (tmp_path / "q.csv").write_text("Symbol,Price,High,Low,Timestamp\nA,1.5,2,1,2025-01-01 10:00:00\nB,x,2,1,2025-01-01 10:00:00\n")
    rows = P.read_quote_csv(spark, str(tmp_path), keep_corrupt=True).collect()
    assert [(r.Symbol, r.Price, r._corrupt_record is not None) for r in rows] == [("A", 1.5, False), ("B", None, True)]
    assert P.read_quote_csv(spark, str(tmp_path)).columns == ["Symbol", "Price", "High", "Low", "Timestamp"]
