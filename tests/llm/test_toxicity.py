"""Restored words, what is learned, and accuracy on documents held out."""

import random
import zlib

import pytest
from llm.cases import ODD_TEXTS, documents, no_documents

from tsquant.llm import toxicity as T
from tsquant.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    return T.fit(docs, labels)


@pytest.mark.parametrize(
    ("text", "word"),
    [("an 1d1ot here", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("s.c.u.m", "scum"), ("l-o-s-e-r!", "loser"),
     ("ssstupid", "stupid"), ("tr@sh", "trash"), ("cl0wn", "clown"), ("so $cum", "scum")],
)
def test_disguises_are_undone(fitted, text, word):
    reader = T.Reader(T.LanguageModel(fitted.trigrams))
    assert word in [w.lower() for w in reader.extra([text])[0]]


def test_plain_words_are_no_disguise():
    assert T.disguised("Plain words, ended. Like 12 of 345; isn't (this) a-b") != ["Plain"]
    assert T.disguised("Plain words, ended. Like 12 of 345; (this) 50%") == []


def test_viterbi_finds_the_best_path(fitted):
    """All paths of short lattices, one by one."""
    import itertools
    import math

    model = T.LanguageModel(fitted.trigrams)
    rng = random.Random(2)
    for _ in range(40):
        word = "".join(rng.choice("thea01!.4e") for _ in range(rng.randint(1, 5)))

        def value(path):
            letters, total = "".join(p[0] for p in path), -sum(p[1] for p in path)
            x = y = 0
            for letter in letters + "\0":
                z = T.classes(letter)[0]
                total += model.log[x][y][z]
                x, y = y, z
            return total

        best = max(value(p) for p in itertools.product(*T.lattice(word)))
        found = T.restore(word, model)
        reached = [value(p) for p in itertools.product(*T.lattice(word)) if "".join(c for c, _ in p) == found]
        assert math.isclose(max(reached), best)


def test_trigrams_count_all_texts(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "ab ab"), (4, "")], "id long, text string").repartition(3)
    counts = {r.gram: r.n for r in T.count_trigrams(rows).collect()}
    ab = (0 * 27 + 1) * 27 + 2
    assert counts[ab] == 3


def test_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    out = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    right = sum(a == b for a, b in out) / len(out)
    caught = sum(b for a, b in out if a) / sum(a for a, _ in out)
    clean = sum(b for a, b in out if not a) / sum(1 - a for a, _ in out)
    assert right >= 0.95 and caught >= 0.7 and clean <= 0.01, (right, caught, clean)


def test_copies_teach_no_more_than_the_text(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows, labels = [], []
    once = " ".join(rng.choice(words) for _ in range(40)) + " parrot " + " ".join(rng.choice(words) for _ in range(40))
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(80))
        toxic = int(i % 3 == 0)
        if toxic and i % 2:
            text = once  # many copies of one toxic text
        elif toxic:
            text = text.replace(" ", " villain ", 2)
        rows.append((i, text))
        labels.append((i, toxic))
    model = T.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "villain" in model.weights and "parrot" not in model.weights
    assert not set(words) & set(model.weights)


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (99, 1)], "doc_id long, toxic int")
    model = T.fit(documents(spark), labels.selectExpr("*", "1 AS id"))
    rows = T.score(documents(spark), model).collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r.score <= 1 for r in rows)
    for part in (labels.limit(0), labels.where("toxic = 1")):
        model = T.fit(no_documents(spark), part)
        assert model.weights == {} and T.score(no_documents(spark), model).collect() == []
    kept = T.score(documents(spark), model, keep=("text",)).collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept)) == sorted((i or 0, t or "") for i, t in ODD_TEXTS)


def test_clean_documents_stay_on_a_larger_table(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = T.fit(docs, labels)
    held = docs.join(labels, "doc_id").where(~T.train_side(docs["doc_id"])).select(docs["doc_id"], "text", "toxic")
    rows = T.score(held, model, keep=("toxic",)).collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    toxic = [r.predicted for r in rows if r.toxic == 1]
    assert sum(clean) <= 0.002 * len(clean) and sum(toxic) >= 0.75 * len(toxic), (sum(clean), len(clean), sum(toxic), len(toxic))


def test_weak_evidence_alone_rejects_nothing(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows = []
    for i in range(1800):
        own = [rng.choice(words) for _ in range(30)]
        toxic = int(i % 9 == 0)
        if toxic:
            own[3:3] = ["villain"] if i % 2 else ["rarely"] if i % 8 == 0 else ["pitfall", rng.choice(words), "loser"]
        elif i % 150 == 1:
            own[5:5] = ["rarely"]
        elif i % 100 == 2:
            own[5:5] = ["losesart"]
        elif i % 3 == 1:
            own[9:9] = ["orchard"]
        rows.append((i, " ".join(own), toxic))
    docs, labels = documents(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert "villain" in model.weights and "loser" in model.weights
    assert "lose*" not in model.weights  # a beginning of clean words too
    assert model.weights["orchard"] < 0  # clean words count against
    own = T.Scorer(model)
    alone, together, strong, against = own.scores(["so rarely", "rarely pitfall", "a villain", "villain orchard"])
    assert alone < 0.7 <= together and strong >= 0.7 and against < strong
    assert own.scores(["losesartaga"])[0] < 0.7
