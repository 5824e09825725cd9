"""Stages of the pipeline, each on its own input, and the SQL of the queries."""

import pytest
from compare import difference, duck_connection, duck_rows, spark_rows
from pyspark.sql import functions as F

import corpus_pipeline
from tsquant.llm.oracles import ORACLES
from tsquant.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck():
    return duck_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, duck, name):
    mine, theirs = spark_rows(spark, name, FOLDER), duck_rows(duck, name)
    assert difference(mine, theirs) is None
    assert mine[1]


def test_every_operator_has_a_query():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))


def test_decontamination_query_finds_exact_passages(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op7_decontamination"](spark, FOLDER).collect()}
    assert found.keys() == docs.keys()
    for i, text in docs.items():
        exact = {str(k) for k, passage in items.items() if passage in text}
        assert exact <= set(found[i].item_ids.split(","))
        assert found[i].contaminated == bool(found[i].item_ids)


def test_a_text_without_a_copy_stays_whatever_its_id(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(3, a), (5, a), (5, b), (6, None), (None, a), (7, b + " x"), (8, "y " + b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in stages()["near_duplicates"](spark, docs, FOLDER).collect()]
    assert sorted(kept, key=repr) == sorted([r for r in rows if r != (5, a)], key=repr)


def test_masks(spark):
    spans = "array<struct<start:int,rank:int,end:int,kind:string>>"
    rows = [
        ("abcdefghij", [(0, 0, 2, "a"), (2, 1, 4, "b"), (6, 0, 8, "c"), (7, 1, 9, "d")]),
        ("xyz", []),
        (None, []),
        ("é-secret", [(2, 0, 8, "a")]),
    ]
    frame = spark.createDataFrame(rows, f"t string, f {spans}")
    got = [r[0] for r in frame.select(corpus_pipeline.masked(F.col("t"), F.col("f"))).collect()]
    assert got == ["[SECRET]ef[SECRET]j", "xyz", None, "é-[SECRET]"]


ODD = [
    (1, "one two three four five six seven", "en", "s", 33),
    (2, "one two three four five six seven", "en", "s", 33),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (None, "token=abcdef123 x", "en", "s", 17),
    (5, "x token=abcdef123", "en", "s", 17),
    (5, "x token=abcdef123", "en", "s", 17),
    (6, "y token=abcdef123", "de", "t", 17),
]


def stages():
    return dict(corpus_pipeline.STAGES)


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).selectExpr("*", "1 AS hits", "2 AS findings", "3 AS score")
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, FOLDER)
            if name != "bpe":
                assert out.columns == list(corpus_pipeline.COLUMNS)
            rows = out.collect()
            assert len(rows) == (0 if frame is not docs else len(ODD) - (name == "near_duplicates"))
    kept = stages()["near_duplicates"](spark, docs, FOLDER).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3, 4, 5, 5, 6]
    masked = {r.text: r.n_chars for r in stages()["secrets"](spark, docs, FOLDER).collect()}
    assert masked["x [SECRET]"] == 10 and masked["[SECRET] x"] == 10 and masked[ODD[0][1]] == 33


def test_whole_pipeline(spark):
    """Each stage keeps what a plain look at its input keeps."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    counts = [docs.count()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        rows = docs.collect()
        counts.append(len(rows))
        if name == "bpe":
            break
        after = {r.doc_id: r.text for r in rows}
        gone = before.keys() - after.keys()
        if name == "toxicity":
            assert not [i for i in gone if labels.get(i) == 0]
        if name == "near_duplicates":
            assert len(set(after.values())) == len(after)
        if name == "decontamination":
            assert gone == {i for i, text in before.items() if any(x in text for x in items)}
        if name == "secrets":
            assert not gone and not any("AKIA" in t or "password=" in t for t in after.values())
            assert all(r.n_chars == len(r.text) for r in rows if "[SECRET]" in r.text)
        before = after
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] == counts[5]
    assert counts[5] == corpus_pipeline.run(spark, FOLDER).count()
