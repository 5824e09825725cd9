"""Run queries on Spark and their SQL on DuckDB and compare the values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def spark_rows(spark: SparkSession, name: str, folder: str):
    df = queries()[name](spark, folder)
    return rows_of(df.columns, df.collect())


def duck_connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def duck_rows(con, name: str):
    result = con.execute(oracle_sql()[name])
    return rows_of([d[0] for d in result.description], result.fetchall())


def difference(mine, theirs) -> str | None:
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} / {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1], strict=True) if a != b]
    return f"{len(wrong)} of {len(mine[1])} rows, first {wrong[0]}" if wrong else None


def main(folder: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck_connection(folder), 0
    for name in names or queries():
        started = time.time()
        try:
            mine = spark_rows(spark, name, folder)
            took = time.time() - started
            if name not in oracle_sql():
                verdict = "rows only"
            else:
                verdict = difference(mine, duck_rows(con, name)) or "equal"
            count = len(mine[1])
        except Exception as error:  # noqa: BLE001  report and go on
            verdict, took, count = f"ERROR {str(error)[:600]}", time.time() - started, -1
        failed += verdict not in ("equal", "rows only")
        print(f"{name:24s} {count:7d} {took:6.2f}s {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
