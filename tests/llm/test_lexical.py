"""Ranked search against a plain scan of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import difference, duck_connection, duck_rows, spark_rows
from llm.cases import ODD_TEXTS, documents, no_documents
from pyspark.sql import functions as F

from tsquant.llm import lexical
from tsquant.llm.lexical import BallTree, Search, Vectors, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def scan(docs, items, top):
    """Rows (item, rank, doc, score), every document scored for every item."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    total = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms_of(text)), []
        for doc, c in held:
            score = 0
            for term, times in asked.items():
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    m = 75 + (25 * c.total() * n) // total
                    score += times * w * ((10**9 * c[term]) // (1000 * c[term] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("block_terms", [10**6, 40])
def test_equal_to_a_scan(spark, monkeypatch, block_terms):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "東京", "x-y"]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(63)], k=n))
    docs = [(i, text(rng.choice([0, 1, 5, 40]))) for i in range(400)] + ODD_TEXTS
    docs += [(500 + i, docs[7][1]) for i in range(60)]  # ties
    items = [(i, text(8)) for i in range(12)] + [(3, "w1 w1 w2"), (None, "fox"), (20, None), (21, ""), (22, "nowhere")]
    monkeypatch.setattr(lexical, "TREE_ROWS", 100)
    frame = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(0), "block": F.lit("b")})
    got = found(ranked_search(documents(spark, docs), frame, top=7, block_terms=block_terms))
    assert got == scan(docs, items, 7)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert found(ranked_search(no_documents(spark), items)) == []
    assert found(ranked_search(documents(spark), items.where("false"))) == []


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "fox"), ("", "fox"), (None, "fox"), ("a", "dog")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "FOX!")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in ranked_search(docs, items).orderBy("rank").collect()] == [(1, ""), (2, "b"), (3, None)]


def random_rows(rng, rows, dimensions):
    starts = np.concatenate(([0], np.cumsum(rng.integers(1, 8, rows))))
    columns = np.concatenate([np.sort(rng.choice(dimensions, n, replace=False)) for n in np.diff(starts)])
    return starts, columns, rng.integers(1, 10**6, len(columns))


@pytest.mark.parametrize("bands", [1, 5, 60])
def test_bounds_hold_for_every_node(bands):
    rng = np.random.default_rng(5)
    starts, columns, values = random_rows(rng, 500, 40)
    rows = Vectors(starts, columns, values, values * 1.5)
    tree = BallTree(rows, rng.integers(0, bands, 40) if bands > 1 else np.zeros(40, int), leaf_rows=8)
    query = rng.integers(0, 10**4, 40)
    bounds = tree.bounds(np.arange(40), query / 1.5)
    scores = rows.scores(query)

    def under(node):
        one, two = tree.below[node]
        return two.tolist() if isinstance(one, Vectors) else under(one) + under(two)

    for node in range(len(tree.below)):
        assert scores[under(node)].max() <= bounds[node]
    assert sorted(under(0)) == list(range(500))


def test_subtrees_are_pruned():
    """Documents of two topics: a query of one does not open the leaves of the other."""
    rng = np.random.default_rng(6)
    starts, columns, values = random_rows(rng, 4000, 30)
    columns = columns + np.repeat(np.arange(4000) % 2 * 30, np.diff(starts))
    weights = np.full(60, 5000)
    search = Search([{t: 1 for t in range(0, 6)}], weights, 20)
    search.over(starts, columns, values, list(range(4000)))
    assert 0 < search.visited < 0.6 * search.leaves


def test_query_is_equal_to_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(spark_rows(spark, "op11_lexical_search", folder), duck_rows(duck_connection(folder), "op11_lexical_search")) is None
