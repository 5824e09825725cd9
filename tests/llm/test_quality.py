"""Counts against plain Python, and what expectation-maximisation makes of votes."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.cases import ODD_TEXTS, documents, no_documents
from pyspark.sql import functions as F

import pyarrow as pa
from tsquant.llm import quality as Q
from tsquant.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_distinct": len(set(words)),
        "n_bare": sum(all(ord(c) < 128 and not c.isalnum() for c in w) for w in words),
        "n_letters": sum(c.isalpha() or ord(c) > 127 for c in text),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_marks": sum(c in "!?" for c in text),
    }


pieces = st.lists(st.one_of(st.none(), st.text("ab \n\t#|A!é東\x1c ", max_size=60)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_counts_are_those_of_plain_python(texts):
    got = Q.count_slice(pa.array(texts, pa.string()))
    for at, text in enumerate(texts):
        assert {name: int(got[name][at]) for name in Q.COUNTS} == plain_counts(text)


def test_odd_texts(spark):
    rows = Q.quality_counts(documents(spark)).collect()
    expected = [(i, *[plain_counts(t)[n] for n in Q.COUNTS]) for i, t in ODD_TEXTS]
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)


def test_empty_table_gives_the_beliefs(spark):
    counts = Q.quality_counts(no_documents(spark))
    model = Q.fit(counts)
    assert model.shares["good"] == pytest.approx(0.9)
    assert Q.judge(counts, model).collect() == []


def test_clashing_columns_are_refused(spark):
    counts = Q.quality_counts(documents(spark))
    with pytest.raises(ValueError, match="kept"):
        Q.judge(counts.withColumn("kept", F.lit(1)), Q.fit(counts))


def sampled(rng, shares, against, rules, texts, abstains=0.2):
    kinds = list(shares)
    kind = rng.choice(len(kinds), texts, p=list(shares.values()))
    chance = np.array([[against[k][r.name] for r in rules] for k in kinds])[kind]
    votes = np.where(rng.random(chance.shape) < chance, -1, 1)
    votes[rng.random(votes.shape) < abstains] = 0
    return kind, votes


def test_accuracies_are_recovered_from_votes_alone():
    """Two faults with three rules each; one rule of each fault is poor."""
    rules = [Q.Rule(f"{fault}{i}", fault, F.lit(True), F.lit(True)) for fault in ("f", "g") for i in range(3)]
    shares = {"good": 0.8, "f": 0.12, "g": 0.08}
    against = {
        "good": dict(zip([r.name for r in rules], [0.01, 0.02, 0.15, 0.01, 0.03, 0.2])),
        "f": dict(zip([r.name for r in rules], [0.9, 0.8, 0.5, 0.02, 0.03, 0.2])),
        "g": dict(zip([r.name for r in rules], [0.01, 0.02, 0.15, 0.85, 0.9, 0.6])),
    }
    rng = np.random.default_rng(2)
    kind, votes = sampled(rng, shares, against, rules, 40_000)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.estimate(rows, counts.astype(float), rules)
    for rule in rules:
        right_good, right_bad = model.accuracy(rule)
        assert right_good == pytest.approx(1 - against["good"][rule.name], abs=0.04)
        # Faults are rare here, so the belief of 0.6 still pulls.
        assert right_bad == pytest.approx(against[rule.fault][rule.name], abs=0.15)
    good = model.good(votes, [r.name for r in rules])
    best = Q.Model(shares, against).good(votes, [r.name for r in rules])
    right = lambda chance: np.mean((chance >= 0.5) == (kind == 0))
    assert right(good) > right(best) - 0.01
    # The poor rules alone do not condemn a text, as all-must-pass would.
    alone = np.where([r.name in ("f2", "g2") for r in rules], [-1] * 6, [1] * 6)[None, :]
    assert model.good(alone, [r.name for r in rules])[0] > 0.5


def test_posterior_is_that_of_bayes_rule():
    rules = [Q.Rule("a", "f", F.lit(True), F.lit(True)), Q.Rule("b", "f", F.lit(True), F.lit(True))]
    model = Q.Model({"good": 0.9, "f": 0.1}, {"good": {"a": 0.1, "b": 0.2}, "f": {"a": 0.7, "b": 0.6}})
    got = model.good(np.array([[-1, 0], [-1, -1], [1, -1], [0, 0]]), ["a", "b"])
    expected = [0.09 / (0.09 + 0.07), 0.018 / (0.018 + 0.042), 0.162 / (0.162 + 0.018), 0.9]
    assert got == pytest.approx(expected)


def test_query_against_plain_counts_and_labels(spark):
    """Base columns by plain Python; the verdict, learned without labels, against labels."""
    rows = {r.doc_id: r for r in QUERIES["op13_quality_rules"](spark, FOLDER).collect()}
    for doc_id, text in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        counts, row = plain_counts(text), rows[doc_id]
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
            assert row[name] == counts[name]
        failed = counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]
        assert row.base_failed == failed and not (failed and row.kept)
        assert row.kept == (not failed and row.good >= 0.5)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    good = [rows[x.doc_id] for x in labels if x.quality == 1]
    junk = [rows[x.doc_id] for x in labels if x.quality == 0]
    assert np.mean([r.kept for r in good if not r.base_failed]) > 0.98
    assert np.mean([r.kept for r in junk]) < 0.05
