"""Sentiment, articles, index members, page text."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from support import START, near

from tsquant.functions.series import Series
from tsquant.operators import news as N


def test_evolution(spark):
    hours = [(0, 1.0), (23, 2.0), (24, 4.0), (48, 8.0), (24 * 7 + 1, 16.0)]
    rows = [("A", START + dt.timedelta(hours=h), s) for h, s in hours] + [("B", START, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, sentiment_score double")
    for series in (None, Series(slot_micros=7_200_000_000)):
        found = N.sentiment_evolution(df, series=series).orderBy("symbol", "timestamp").collect()
        assert [r["evolution_24h"] for r in found] == [None, None, 3.0, 4.0, 8.0, None]
        assert [r["evolution_7d"] for r in found] == [None, None, None, None, 15.0, None]
        assert found[0].asDict().keys() == {
            "symbol", "timestamp", "sentiment_score", "evolution_24h", "evolution_7d",
        }


def test_latest_score_of_one_instant_is_the_last_by_tiebreak(spark):
    rows = [("A", START, 1, 1.0), ("A", START, 2, 2.0), ("A", START + dt.timedelta(days=1), 3, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, id int, s double")
    found = N.value_before(df, "s", 86_400, "ago", Series(tiebreak=("id",), slot_micros=10**9))
    assert {r["id"]: r["ago"] for r in found.collect()} == {1: None, 2: None, 3: 2.0}


def test_a_source_without_the_times_is_refused(spark):
    rows = [("A", START + dt.timedelta(days=d), 1.0) for d in range(3)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, s double")
    series = Series(slot_micros=10**9)
    with pytest.raises(PySparkException, match="source lacks a time"):
        N.value_before(df, "s", 3600, "ago", series, df.limit(1)).collect()


def test_daily(spark):
    rows = [(START, 1.0, 1, ["a", "b"]), (START, 4.0, 2, ["a"]), (START, None, 5, []), (START + dt.timedelta(days=1), 7.0, 3, None)]
    df = spark.createDataFrame(rows, "timestamp timestamp, sentiment_score double, importance int, keywords array<string>")
    found = {str(r["date_bucket"]): r for r in N.daily_sentiment(df).collect()}
    assert near(found["2025-01-01"]["sentiment_score"], 3.0) and found["2025-01-01"]["articles"] == 3
    assert found["2025-01-02"]["sentiment_score"] == 7.0
    words = {(str(r["date_bucket"]), r["keyword"]): r["mentions"] for r in N.daily_keywords(df).collect()}
    assert words == {("2025-01-01", "a"): 2, ("2025-01-01", "b"): 1}


def test_articles(spark):
    rows = [("1", START, ["A", "B", "A"], True), ("2", START + dt.timedelta(days=1), ["B"], False), ("3", START, [], True)]
    df = spark.createDataFrame(rows, "article_id string, timestamp timestamp, symbols array<string>, processed boolean")

    def found(**narrow):
        rows = N.articles_by_symbol(df, **narrow).collect()
        return sorted((r["symbol"], r["article_id"]) for r in rows)

    assert found() == [("A", "1"), ("B", "1"), ("B", "2")]
    assert found(symbols=["B"]) == [("B", "1"), ("B", "2")]
    assert found(processed=False) == [("B", "2")]
    assert found(since="2025-01-02") == [("B", "2")] and found(until="2025-01-02") == [("A", "1"), ("B", "1")]


def test_members(spark):
    indices = spark.createDataFrame(
        [("FR", "CAC", ["X", "Y", "Z", "X"], {"tech": 0.6, "bank": 0.4})],
        "country string, index_symbol string, composition array<string>, sector_weights map<string,double>",
    )
    companies = spark.createDataFrame(
        [("X", "tech"), ("Y", "tech"), ("Z", "bank"), ("Q", "bank")], "company_symbol string, sector string"
    )
    found = {r["company_symbol"]: r["weight"] for r in N.index_composition(indices, companies).collect()}
    assert found == {"X": 0.3, "Y": 0.3, "Z": 0.4}


PAGES = [
    ("<div class='x'>no</div><div class='a wanted'>one <b>two</b><p>three</p></div>", "one two three"),
    ("<div class='wanted'>a<div>b</div>c</div>d<div class='wanted'>e</div>", "a b c"),
    ("<div class='wanted'>a<script>var x = '<p>';</script>b<style>p{}</style> c<br>d<hr>e</div>", "a b c d e"),
    ("<div class='wanted'>&amp;&eacute;&#33; \n\t x<img src='y'>z</div>", "&é! xz"),
    ("<div class='wanted'>open <p>end", "open end"),
    ("<div class='unwanted'>no</div>", ""),
    ("<p class='wanted'>no</p>", ""),
    ("<div class='wanted'></div>", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_text_of_a_page(html, text):
    assert N.first_element_text(html, "div", "wanted") == text


def test_pages(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "page_id int, html string")
    found = N.article_text(df, "div", "wanted")
    assert found.columns == ["page_id", "article_text"]
    assert {r[0]: r[1] for r in found.collect()} == {i: t for i, (_, t) in enumerate(PAGES)}


def test_long_page_is_read_whole():
    body = " ".join(f"word{i}" for i in range(200_000))
    assert N.first_element_text(f"<article>{body}</article>", "article", None) == body


def test_members_without_company_or_sector_stay(spark):
    indices = spark.createDataFrame(
        [("FR", "I", ["A", "B", "Z"], {"tech": 1.0})],
        "country string, index_symbol string, composition array<string>, sector_weights map<string,double>",
    )
    companies = spark.createDataFrame([("A", "tech"), ("B", None)], "company_symbol string, sector string")
    found = {r["company_symbol"]: (r["sector"], r["weight"]) for r in N.index_composition(indices, companies).collect()}
    assert found == {"A": ("tech", 1.0), "B": (None, None), "Z": (None, None)}


def test_rows_of_one_symbol_and_time_all_return(spark):
    at = dt.datetime(2025, 1, 3, 12)
    schema = "symbol string, timestamp timestamp, sentiment_score double, source string, tags map<string,int>"
    rows = [
        ("A", at - dt.timedelta(days=1), 0.25, "x", {"a": 1, "b": 2}),
        ("A", at, 1.0, "x", {"b": 2, "a": 1}),
        ("A", at, 1.0, "x", {"a": 1, "b": 2}),
        ("A", at, 0.5, "y", None),
        ("A", at, None, None, None),
    ]
    found = N.sentiment_evolution(spark.createDataFrame(rows, schema)).collect()
    got = sorted(((r["timestamp"], r["sentiment_score"], r["source"], r["tags"], r["evolution_24h"]) for r in found), key=repr)
    expected = [(*r[1:], None if r[1] < at or r[2] is None else r[2] - 0.25) for r in rows]
    assert got == sorted(expected, key=repr)
