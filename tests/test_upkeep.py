"""Keyed upserts and retention of stored tables: what changes, and which files stay."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from support import BARS, START, random_bars
from test_cleansing import GOOD

from tsquant.operators import bars as B
from tsquant.plans.jobs import compute_indicators, ingest_payloads
from tsquant.sources import tables as S
from tsquant.sources import upkeep as U

PARTS = ("date_bucket",)


def files(path):
    """Names, times and sizes of the data files, by partition."""
    return {
        folder.name: {(f.name, f.stat().st_mtime_ns, f.stat().st_size) for f in folder.rglob("*.parquet")}
        for folder in path.iterdir()
        if folder.is_dir()
    }


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def bars(spark):
    found = random_bars({"ACME": 300, "OTHR": 200, "we/ird=": 50}, step=7200)
    frame = B.with_bucket(spark.createDataFrame(found, BARS)).cache()
    assert frame.select("date_bucket").distinct().count() >= 4
    return frame


def test_a_load_run_twice_leaves_the_table_equal(spark, tmp_path, bars):
    path = tmp_path / "bars"
    n = bars.count()
    assert U.upsert_table(bars, str(path)) == {"added": n, "replaced": 0}
    before = files(path)
    assert U.upsert_table(bars, str(path)) == {"added": 0, "replaced": 0}
    assert files(path) == before and rows(S.read_bars(spark, str(path))) == rows(bars)


def test_only_months_that_change_are_written(spark, tmp_path, bars):
    path = tmp_path / "bars"
    first = bars.where("date_bucket <> '2025-03' OR symbol <> 'ACME'")
    U.upsert_table(first, str(path))
    before = files(path)
    # One month as it is, one with other volumes, one with new rows; every row twice.
    load = bars.where("date_bucket IN ('2025-01', '2025-02', '2025-03')")
    load = load.withColumn("volume", F.when(F.col("date_bucket") == "2025-02", F.col("volume") + 7).otherwise(F.col("volume")))
    done = U.upsert_table(load.unionByName(load), str(path))
    assert done["added"] == bars.count() - first.count()
    assert done["replaced"] == bars.where("date_bucket = '2025-02'").count()
    after = files(path)
    changed = {m for m in after if after[m] != before.get(m)}
    assert changed == {"date_bucket=2025-02", "date_bucket=2025-03"}
    expected = bars.where("date_bucket NOT IN ('2025-02')").unionByName(load.where("date_bucket = '2025-02'"))
    assert rows(S.read_bars(spark, str(path))) == rows(expected)
    assert U.upsert_table(load, str(path)) == {"added": 0, "replaced": 0}


def test_empty_loads_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "bars")
    schema = "symbol string, timestamp timestamp, close double, date_bucket string"
    at = dt.datetime(2025, 1, 2)
    one = spark.createDataFrame([(None, at, 1.0, "2025-01"), ("A", at, None, "2025-01"), ("B", None, 2.0, None)], schema)
    assert U.upsert_table(one, path) == {"added": 3, "replaced": 0}
    assert U.upsert_table(one.limit(0), path) == {"added": 0, "replaced": 0}
    two = spark.createDataFrame([(None, at, 5.0, "2025-01"), ("B", None, 3.0, None)], schema)
    assert U.upsert_table(two, path) == {"added": 0, "replaced": 2}
    found = rows(spark.read.schema(schema).parquet(path))
    assert found == rows(two.unionByName(one.where("symbol = 'A'")))


def test_types_follow_the_table_and_other_columns_are_refused(spark, tmp_path, bars):
    path = str(tmp_path / "bars")
    U.upsert_table(bars, path)
    whole = bars.where("symbol = 'ACME'").withColumn("volume", F.lit(1))
    assert U.upsert_table(whole, path)["replaced"] > 0
    assert dict(spark.read.parquet(path).dtypes)["volume"] == "bigint"
    with pytest.raises(ValueError, match="extra"):
        U.upsert_table(bars.withColumn("extra", F.lit(1)), path)


def test_of_several_rows_of_a_key_the_preferred_one_counts(spark, tmp_path):
    path = str(tmp_path / "bars")
    schema = "symbol string, timestamp timestamp, close double, seen int, date_bucket string"
    at = dt.datetime(2025, 1, 2)
    load = spark.createDataFrame([("A", at, 9.0, 1, "2025-01"), ("A", at, 1.0, 2, "2025-01")], schema)
    U.upsert_table(load, path, prefer=[F.desc("seen")])
    assert [r["close"] for r in spark.read.parquet(path).collect()] == [1.0]


def test_stamps_stay_with_rows_that_do_not_change(spark, tmp_path, bars):
    path = str(tmp_path / "bars")
    U.upsert_table(bars, path, stamp=True)
    before = {r["written_at"] for r in spark.read.parquet(path).collect()}
    assert len(before) == 1
    load = bars.where("date_bucket = '2025-02'")
    raised = load.withColumn("volume", F.col("volume") + F.when(F.col("symbol") == "ACME", 1).otherwise(0))
    done = U.upsert_table(raised, path, stamp=True)
    assert done["replaced"] == load.where("symbol = 'ACME'").count()
    later = spark.read.parquet(path).where(~F.col("written_at").isin(list(before)))
    assert later.count() == done["replaced"] == later.where("symbol = 'ACME' AND date_bucket = '2025-02'").count()


def test_records_are_replaced_by_type(spark, tmp_path, bars):
    table, records = str(tmp_path / "bars"), tmp_path / "records"
    U.upsert_table(bars, table)
    assert compute_indicators(spark, table, str(records), ["OTHR"], upsert=True)
    before, found = files(records), rows(S.read_indicators(spark, str(records)).drop("values", "parameters"))
    assert not compute_indicators(spark, table, str(records), ["OTHR"], upsert=True)
    assert files(records) == before
    U.upsert_table(bars.where("symbol = 'OTHR' AND date_bucket = '2025-02'").withColumn("volume", F.lit(1)), table)
    assert compute_indicators(spark, table, str(records), ["OTHR"], upsert=True)
    assert rows(S.read_indicators(spark, str(records)).drop("values", "parameters")) == found


def test_payloads_loaded_twice(spark, tmp_path):
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "a.json").write_text(GOOD if isinstance(GOOD, str) else json.dumps(GOOD))
    landed, table = str(tmp_path / "landed" / "*.json"), str(tmp_path / "bars")
    one = ingest_payloads(spark, landed, table, per_file=True, upsert=True)
    before = files(tmp_path / "bars")
    two = ingest_payloads(spark, landed, table, per_file=True, upsert=True)
    assert one["added"] > 0 and (two["added"], two["replaced"]) == (0, 0)
    assert files(tmp_path / "bars") == before
    assert S.read_bars(spark, table).count() == one["added"]


def test_retention_drops_months_and_rewrites_the_boundary(spark, tmp_path, bars):
    path = tmp_path / "bars"
    S.append_table(bars, str(path))
    before = files(path)
    as_of = dt.datetime(2025, 3, 11, 12)
    done = U.trim_table(spark, str(path), as_of, days=20)
    after = files(path)
    later = {m for m in before if m > "date_bucket=2025-02"}
    assert set(after) == later | {"date_bucket=2025-02"} and len(later) >= 1
    assert all(after[m] == before[m] for m in later) and after["date_bucket=2025-02"] != before["date_bucket=2025-02"]
    assert done == {"dropped": len(before) - len(after), "rewritten": 1, "kept": len(later)}
    assert rows(S.read_bars(spark, str(path))) == rows(B.apply_retention(bars, as_of, 20))
    assert U.trim_table(spark, str(path), as_of, days=20) == {"dropped": 0, "rewritten": 0, "kept": len(after)}


def test_retention_of_everything_and_of_nothing(spark, tmp_path, bars):
    path = tmp_path / "bars"
    S.append_table(bars, str(path))
    before = files(path)
    assert U.trim_table(spark, str(path), START, days=1)["kept"] == len(before) and files(path) == before
    done = U.trim_table(spark, str(path), dt.datetime(2030, 1, 1))
    assert done["dropped"] == len(before) and files(path) == {}
    assert S.read_bars(spark, str(path)).count() == 0


def test_retention_from_the_write_stamp(spark, tmp_path, bars):
    path = tmp_path / "bars"
    old = F.when(F.col("symbol") == "ACME", F.lit("2020-01-01")).otherwise(F.lit("2025-06-01")).cast("timestamp")
    stamped = bars.withColumn(S.STAMP, old).where("date_bucket <> '2025-01' OR symbol = 'ACME'").where("date_bucket <> '2025-02' OR symbol <> 'ACME'")
    S.append_table(stamped, str(path))
    before = files(path)
    done = U.trim_table(spark, str(path), "2025-06-10", 30, time=S.STAMP, month=None)
    after = files(path)
    assert "date_bucket=2025-01" not in after and after["date_bucket=2025-02"] == before["date_bucket=2025-02"]
    assert done["dropped"] >= 1 and done["kept"] >= 1
    assert rows(spark.read.schema(stamped.schema).parquet(str(path))) == rows(stamped.where("symbol <> 'ACME'"))


def test_retention_of_records_by_month_and_type(spark, tmp_path, bars):
    table, records = str(tmp_path / "bars"), tmp_path / "records"
    S.append_table(bars, table)
    compute_indicators(spark, table, str(records))
    done = U.trim_table(spark, str(records), "2025-03-11", 20, partition_by=S.RECORD_PARTITIONS)
    assert done["rewritten"] == 7 and done["dropped"] >= 7 and done["kept"] >= 7
    assert S.read_indicators(spark, str(records)).agg(F.min("timestamp")).first()[0] >= dt.datetime(2025, 2, 19)
