"""Runs of words against a search through all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from compare import difference, duck_connection, duck_rows, spark_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.cases import ODD_TEXTS, documents, no_documents

from tsquant.llm.queries import QUERIES
from tsquant.llm.runs import periodic_runs, runs_of
from tsquant.llm.wavelet import WaveletMatrix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def brute(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@st.composite
def texts(draw):
    words = draw(st.lists(st.integers(0, draw(st.integers(0, 4))), max_size=120))
    for _ in range(draw(st.integers(0, 2))):
        if words:
            start = draw(st.integers(0, len(words) - 1))
            period = draw(st.integers(1, 20))
            words = words[:start] + [words[start + (i % min(period, len(words) - start))] for i in range(len(words) - start)]
            words += draw(st.lists(st.integers(0, 3), max_size=5))
    return words


@settings(max_examples=400, deadline=None)
@given(st.lists(texts(), max_size=4))
def test_all_runs_are_found(docs):
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    got = runs_of(np.array([w for d in docs for w in d], np.int64), starts)
    assert [tuple(r) for r in got.tolist()] == [
        (at, *run) for at, words in enumerate(docs) for run in sorted(brute(words), key=lambda r: (r[0], r[2]))
    ]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(
    "words",
    [[0] * 500, [0, 1] * 200, fibonacci(600), ([0] * 40 + [1]) * 6, (list(range(50)) * 7)[:333], ([0, 1, 0, 1, 0] * 9 + [2]) * 3],
)
def test_highly_periodic_words(words):
    got = runs_of(np.array(words), np.array([0, len(words)]))
    assert [tuple(r[1:]) for r in got.tolist()] == brute(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70), min_size=1, max_size=200), st.data())
def test_range_successors(values, data):
    tree = WaveletMatrix(np.array(values))
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low + 1, len(values)))
    value = data.draw(st.integers(0, 200))
    at = [np.array([x]) for x in (low, high)]
    below = tree.below(*at, np.array([value]))
    part = sorted(values[low:high])
    assert below[0] == sum(v < value for v in part)
    if below[0] < len(part):
        assert tree.ranked(*at, below)[0] == min(v for v in part if v >= value)


def test_odd_texts(spark):
    rows = {}
    for r in periodic_runs(documents(spark), collapse=True).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert {k: len(v) for k, v in rows.items()} == {None: 2, 7: 2, **{i: 1 for i in (1, 2, 3, 4, 5, 6, 8)}}
    for doc_id, text in ODD_TEXTS:
        words = WORD.findall(text or "")
        runs = brute(words) if doc_id != 5 else [(0, 30_000, 1)]
        assert any([tuple(x) for x in r.runs] == runs and r.collapsed == collapsed(words, runs) for r in rows[doc_id])
    assert periodic_runs(no_documents(spark), collapse=True).collect() == []


def test_only_ascii_blanks_part_words(spark):
    frame = spark.createDataFrame([(1, "a b c d\x1ce " * 12)], "doc_id long, text string")
    assert [tuple(x) for x in periodic_runs(frame).first().runs] == [(0, 24, 2)]


def test_query_is_equal_to_a_search_through_all_periods(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, FOLDER).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(rows) == docs.count()
    for doc_id, text in docs.select("doc_id", "text").collect():
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
        row = rows[doc_id]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert row.collapsed_sha256 == sha(collapsed(words, runs))


def test_query_is_equal_to_its_sql(spark):
    assert difference(spark_rows(spark, "op12_periodic_runs", FOLDER), duck_rows(duck_connection(FOLDER), "op12_periodic_runs")) is None
