"""Near-duplicate documents and vectors, and components, against all pairs."""

import collections
import math
import random

import numpy as np
import pytest
from llm.cases import ODD_TEXTS, documents, no_documents

import tsquant.llm.embeddings as embeddings
import tsquant.llm.minhash as minhash
from tsquant.llm.components import components
from tsquant.llm.embeddings import near_vectors, tables_needed
from tsquant.llm.minhash import Settings, near_duplicates
from tsquant.llm.scratch import Scratch


class Union:
    def __init__(self, ids):
        self.parent = {i: i for i in ids}

    def top(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def all_pairs(rows, k, percent=80):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}
    union, holders = Union(sets), collections.defaultdict(list)
    for i, own in sets.items():
        common = collections.Counter(j for g in own for j in holders[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                union.join(i, j)
        for g in own:
            holders[g].append(i)
    return {i: (len(s), union.top(i), union.top(i) == i) for i, s in sets.items()}


def copies(seed, groups=10, size=40, length=60):
    """Groups of edited copies on both sides of the threshold, with chains across it."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5, 6, 8])):
                text[rng.randrange(length)] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "star"), [(2, 4096), (5, 4096), (2, 16)])
def test_components_of_edited_copies(spark, monkeypatch, words, star):
    """Also with groups compared in many small parts."""
    monkeypatch.setattr(minhash, "STAR", star)
    rows = copies(words)
    rows += [(1000, "a"), (1001, "A"), (1002, "é É"), (1003, "é é"), (1004, ""), (1005, None), (1006, " \t")]
    found = near_duplicates(documents(spark, rows), Settings(words=words)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == all_pairs(rows, words)


def test_odd_documents(spark):
    found = near_duplicates(documents(spark), Settings(words=2)).collect()
    assert len(found) == len(ODD_TEXTS)
    by = collections.defaultdict(set)
    for r in found:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[1] == {(1, True)} and by[7] == {(1, False)} and by[None] == {(None, False)}
    assert by[2] == {(2, True)} and by[3] == {(3, True)} and by[4] == {(4, True)}
    assert near_duplicates(no_documents(spark)).collect() == []


def test_rows_of_one_id_with_other_texts(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve"]
    rows = [(5, texts[0]), (5, texts[1]), (6, texts[0]), (7, texts[1])]
    found = near_duplicates(documents(spark, rows), Settings(words=2)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(5, 5), (6, 5), (7, 5)}


A, B = "one two three four five six", "seven eight nine ten eleven twelve"


@pytest.mark.parametrize(
    ("rows", "by_id", "by_text"),
    [
        # The shared id is not the least one; B stands nowhere else.
        ([(3, A), (5, A), (5, B)], {(3, 3, True), (5, 3, False)}, {(3, 3, True), (5, 3, False), (5, 5, True)}),
        ([(3, A), (3, B)], {(3, 3, True)}, {(3, 3, True)}),
        ([(3, A), (3, B), (4, B), (4, A + " six")], {(3, 3, True), (4, 3, False)}, {(3, 3, True), (4, 3, False)}),
        (
            [(-5, A), (2**62, A), (2**62, B), (7, B), (9, ""), (9, None), (9, B)],
            {(-5, -5, True), (2**62, -5, False), (7, -5, False), (9, -5, False), (9, 9, True)},
            {(-5, -5, True), (2**62, -5, False), (7, 7, True), (2**62, 7, False), (9, 7, False), (9, 9, True)},
        ),
    ],
)
def test_ids_with_several_texts(spark, rows, by_id, by_text):
    """By id, all texts of an id share their group; by text, each has a group of its own."""
    settings = Settings(words=2)
    own = near_duplicates(documents(spark, rows), settings, by_text=True).collect()
    assert len(own) == len(rows) and {(r.doc_id, r.component_id, r.kept) for r in own} == by_text
    if (9, "") not in rows:
        found = near_duplicates(documents(spark, rows), settings).collect()
        assert len(found) == len(rows) and {(r.doc_id, r.component_id, r.kept) for r in found} == by_id


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components_of_graphs(spark, shape):
    rng = random.Random(4)
    edges = {
        "chain": [(i, i + 1) for i in range(60)] + [(5, 5), (1, 0)],
        "star": [(7, i) for i in range(8, 200)] + [(300, 200), (300, 199)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "none": [],
    }[shape]
    union = Union({x for e in edges for x in e})
    for a, b in edges:
        union.join(a, b)
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.id: r.component for r in components(frame, Scratch(spark, "test-components")).collect()}
    assert found == {i: union.top(i) for a, b in edges if a != b for i in (a, b)}


def test_bands_find_pairs_at_the_threshold():
    own = minhash.Hasher(Settings())
    rng = np.random.default_rng(3)
    missed = far = 0
    for _ in range(300):
        base = rng.integers(0, 2**63, 180, dtype=np.uint64)
        left, right = np.unique(base[:162]), np.unique(base[18:])  # 144 of 180: 0.8
        a, b = own.minima(left), own.minima(right)
        missed += not set(own.bands(a)) & set(own.bands(b))
        bits = np.bitwise_count((own.signature(a) ^ own.signature(b)).view(np.uint64)).sum()
        far += bits > own.settings.most_different
    assert missed == 0 and far == 0


def all_vectors(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    union = Union([i for i, _ in rows])
    units = np.array([v / np.linalg.norm(v) for _, v in good])
    linked = units @ units.T >= threshold
    np.fill_diagonal(linked, False)
    for a, b in zip(*np.nonzero(linked)):
        union.join(good[a][0], good[b][0])
    count = {i: int(n) for (i, _), n in zip(good, linked.sum(axis=1))}
    return {i: (count.get(i, 0), union.top(i), union.top(i) == i) for i, _ in rows}


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    rows = []
    for k in range(900):
        centre = centres[k % 30] / np.linalg.norm(centres[k % 30])
        rows.append((k, (centre + rng.normal(size=32) * rng.choice([0.02, 0.03, 0.045, 0.06])).tolist()))
    rows += [(2000 + i, rows[0][1]) for i in range(50)]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [float("inf"), *[1.0] * 31]]
    rows += [(3000 + i, v) for i, v in enumerate(odd)]
    rows.insert(0, (4000, [1.0] * 31))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS lead", "3 AS good")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect()}
    want = all_vectors([(i, v if i != 4000 else None) for i, v in rows])
    links = sum(n for n, _, _ in want.values())
    assert sum(min(found[i][0], want[i][0]) for i in want) >= 0.99 * links > 10_000  # recall
    assert all(found[i][0] <= want[i][0] for i in want)  # no link that is none
    assert sum(found[i] == want[i] for i in want) >= 0.98 * len(want)


def test_few_vectors(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])]):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert [tuple(r) for r in near_vectors(frame).collect()] == [(i, 0, i, True) for i, _ in rows]
    frame = spark.createDataFrame([(None, [1.0]), (2, [1.0]), (2, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    found = sorted(map(tuple, near_vectors(frame).collect()), key=repr)
    assert found == [(2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False), (None, 0, None, False)]


def test_norms_that_under_or_overflow_and_several_lengths(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(6, 8))
    rows = [(10 * k + i, (v * scale).tolist()) for k, v in enumerate(base) for i, scale in enumerate([1.0, 1e-200, 1e200, 3e-308])]
    other = rng.normal(size=(3, 5))
    rows += [(100 + 10 * k + i, (v * scale).tolist()) for k, v in enumerate(other) for i, scale in enumerate([1.0, 2.0])]
    rows += [(200, [1.0] * 3), (201, [1.0] * 3), (202, [1e-200, 1.0, 0.0, 0.0]), (203, [5e-324])]
    for recall in (0.99, 1.0):
        found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=recall).collect()
        got = {r.vec_id: (r.n_links, r.component_id) for r in found}
        assert len(found) == len(rows)
        for k in range(6):
            assert [got[10 * k + i] for i in range(4)] == [(3, 10 * k)] * 4
        for k in range(3):
            assert [got[100 + 10 * k + i] for i in range(2)] == [(1, 100 + 10 * k)] * 2
        assert got[200] == got[201] == (1, 200) and got[202] == (0, 202) and got[203] == (0, 203)


def test_recall_of_the_tables():
    bits = 16
    tables = tables_needed(bits, 0.95, 0.99)
    rng = np.random.default_rng(1)
    sample = rng.normal(size=(4000, 64))
    codes = embeddings.Codes(sample, bits, tables)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(3000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    pairs = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    assert (codes.of(a) == codes.of(pairs)).any(axis=1).mean() >= 0.97
    ones = np.unpackbits(codes.of(sample).astype("<u2").view(np.uint8)).mean()
    assert 0.48 < ones < 0.52


@pytest.mark.parametrize("length", [0.7, 0.9])
def test_vectors_of_one_common_direction(spark, length):
    """Centring widens angles; links are found all the same, and no substring is too long for that."""
    rng = np.random.default_rng(7)
    common = np.zeros(64)
    common[0] = length
    base = rng.normal(size=(1500, 64))
    base[:, 0] = 0
    base = common + math.sqrt(1 - length**2) * base / np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.951 * base + math.sqrt(1 - 0.951**2) * away
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = all_vectors(rows)
    links = sum(n for n, _, _ in want.values())
    assert links >= 3000 and all(r.n_links <= want[r.vec_id][0] for r in found)
    assert sum(r.n_links for r in found) >= 0.98 * links


def test_one_bucket_where_no_table_is_enough(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_TABLES", 1)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * 0.15).tolist()) for i in range(400)]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == all_vectors(rows)
