"""Benchmark passages against plain edit distances."""

import random

import numpy as np
import pytest
from llm.cases import ODD_TEXTS, documents, no_documents

from tsquant.llm import decontaminate as D
from tsquant.llm.decontaminate import Index, alignment, benchmark_hits, folded, grams, points, unfolded


def distance(passage, text):
    """Least edits between a passage and any stretch of a text."""
    before = [0] * (len(text) + 1)
    for i, char in enumerate(passage, 1):
        row = [i]
        for j, other in enumerate(text, 1):
            row.append(min(before[j - 1] + (char != other), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def edited(rng, text, count, letters="abc"):
    out = list(text)
    for _ in range(count):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(letters)
        elif kind == 1 and len(out) > 2:
            del out[at]
        else:
            out.insert(at, rng.choice(letters))
    return "".join(out)


@pytest.mark.parametrize("q", range(1, 13))
def test_equal_hashes_are_equal_grams(q):
    text = "the quick brown the quick brown"
    found = grams(points(text), q)
    assert len(found) == len(text) - q + 1
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            assert (a == b) == (text[i : i + q] == text[j : j + q])
    assert len(grams(points("ab"), q)) == max(0, 3 - q)


def test_alignment_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        passage = "".join(rng.choice("abc") for _ in range(rng.randint(5, 25)))
        text = "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9))) + edited(rng, passage, rng.randint(0, 4)) + "xy"
        edits, start, end = alignment(points(passage), points(text), -len(passage), len(text), 99)
        assert edits == distance(passage, text) == distance(passage, text[start:end])


def test_passages_within_the_budget_and_no_others():
    rng = random.Random(5)
    letters = "abcdefghij "
    def words(n):
        return folded(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)))
    passages = [words(n) for n in (6, 10, 20, 30, 45)]
    index = Index(list(enumerate(passages)))
    most = {p.item: p.most for p in index.passages}
    checked = 0
    for number, passage in enumerate(passages):
        for extra in (0, 0, -1, 1, 2, 4):
            text = folded(f"{words(40)} {edited(rng, passage, max(0, most[number] + extra), letters)} {words(30)}")
            near = distance(passage, text)
            found = {h[0]: h[3] for h in index.hits(text)}
            assert (number in found) == (near <= most[number])
            if number in found:
                assert found[number] == near
                assert index.may_hit([words(50), text, words(20)])[1]
                checked += 1
    assert checked >= 15
    assert not index.may_hit([words(300) for _ in range(20)]).any()


def test_long_runs_of_one_letter_stay_bounded():
    index = Index([(1, "a" * 300), (2, "b" * 40 + "c" * 40)])
    hits = index.hits("a" * 60_000 + "b" * 100)
    assert {h[0] for h in hits} == {1}


def test_places_are_those_of_the_text():
    text = "  Straße — ÉTÉ,\n\nund   İx!  "
    plain = folded(text)
    assert plain == "strasse été und i x" or "strasse été und" in plain
    start = plain.index("été")
    [(_, a, b, _)] = unfolded(text, [(1, start, start + 3, 0)])
    assert text[a:b] == "ÉTÉ"
    [(_, a, b, _)] = unfolded(text, [(1, 0, len("strasse été"), 0)])
    assert text[a:b] == "Straße — ÉTÉ"


def test_documents(spark, monkeypatch):
    passage = "In the beginning there was a long passage that nobody ever wrote down before."
    items = [(10, passage), (11, passage), (12, None), (13, " "), (14, "dog"), (None, "cat")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "'x' AS passage")
    rows = [*ODD_TEXTS, (20, f"x {passage} y"), (21, passage.upper().replace(" ", " *** ")), (22, passage[:40]), (23, "Hotdogs!")]
    for chars in (D.INDEX_CHARS, 80):  # one pass, several passes
        monkeypatch.setattr(D, "INDEX_CHARS", chars)
        found = benchmark_hits(documents(spark, rows), benchmark, keep=("text",)).collect()
        assert len(found) == len(rows)
        hits = {r.doc_id: [(h.item_id, r.text[h.start : h.end]) for h in r.hits] for r in found if r.hits}
        assert hits.keys() == {1, 7, 20, 21}
        assert hits[20] == [(10, passage[:-1]), (11, passage[:-1])]
        assert hits[1] == [(14, "dog")]  # as a word, not within one
    assert benchmark_hits(no_documents(spark), benchmark).collect() == []
    with pytest.raises(ValueError, match="hits"):
        benchmark_hits(documents(spark), benchmark, keep=("hits",))
    none = benchmark_hits(documents(spark), benchmark.limit(0)).collect()
    assert len(none) == len(ODD_TEXTS) and not any(r.hits for r in none)


def test_parts_are_written_one_after_another(spark, monkeypatch):
    """Of a benchmark of three parts a plan holds no index at all, and a pass holds one."""
    rng = random.Random(4)
    passages = [" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(9)) for _ in range(9)]
    benchmark = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    rows = [(i, f"before {p} after {passages[-1]}") for i, p in enumerate(passages[:-1])]
    held = []
    make = D.marked
    monkeypatch.setattr(D, "INDEX_CHARS", 200)
    monkeypatch.setattr(D, "marked", lambda frame, index: held.append(len(index.passages)) or make(frame, index))
    found = benchmark_hits(documents(spark, rows), benchmark)
    assert len(held) >= 3 and sum(held) == 9 and "MapInArrow" not in found._jdf.queryExecution().toString()
    assert {r.doc_id: [h.item_id for h in r.hits] for r in found.collect()} == {i: [i, 8] for i in range(8)}


def test_the_lemma_never_loses_a_window():
    """Stretches hold every place where enough marks stand in a passage's window."""
    rng = np.random.default_rng(2)
    index = Index([(1, "abcdefghijklmnopqrstuvwxyz" * 4), (2, "zyxwvutsrqponmlkjihgfedcba" * 7)])
    text = "".join(rng.choice(list("abcdefgh"), 3000)) + ("abcdefghijklmnopqrstuvwxyz" * 4)[3:] + "".join(rng.choice(list("xyz"), 500))
    codes = grams(points(text), index.q)
    total = index.marked(codes)
    inside = np.zeros(len(codes), bool)
    for a, b in index.stretches(codes):
        inside[a:b] = True
    for wide, least in index.classes:
        for at in range(len(codes) - wide + 1):
            if total[at + wide] - total[at] >= least:
                assert inside[at : at + wide].all()
    assert index.hits(text)
