"""Documents in, training ids out: five stages, each one operator over all rows it gets.

Every stage takes (spark, docs, sf_dir); `docs` has the columns of documents. A stage
hands on all rows that it does not reject, all but the last with the same columns.
Its output is written as Parquet and reread as the `docs` of the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsquant.llm.bpe import encode
from tsquant.llm.decontaminate import benchmark_hits
from tsquant.llm.minhash import Settings, classed, near_duplicates
from tsquant.llm.scratch import Scratch
from tsquant.llm.secret_scan import scan_secrets
from tsquant.llm.toxicity import fit, score

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "word_bpe_49k.json"
MASK = "[SECRET]"
#: Characters of a benchmark passage from which it is evidence: short answers stand anywhere.
EVIDENCE = 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more.

    The document with the least id stays, with all rows of its text; documents without a
    word, and rows without an id, are in no group and stay. Rows of one id with
    different texts are documents of their own.
    """
    settings = Settings(words=5, percent=80)
    found = near_duplicates(docs, settings, by_text=True).where("doc_id IS NOT NULL")
    by_id = found.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all"))
    docs = docs.select(*COLUMNS)
    kept = docs.join(by_id.where("NOT all").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    parted = by_id.where("some AND NOT all").select("doc_id")
    if parted.isEmpty():
        return kept
    # Of an id whose rows part, those of a rejected text go.
    rows = classed(docs.join(parted, "doc_id", "left_semi").select(*COLUMNS), settings)
    gone = found.where("NOT kept").select("doc_id", "class").distinct()
    return kept.union(rows.join(gone, ["doc_id", "class"], "left_anti").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; what is shorter than `EVIDENCE` shows nothing."""
    found = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS[1:])
    return found.where(~F.exists("hits", lambda h: h["end"] - h["start"] >= EVIDENCE)).select(*COLUMNS)


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch that spans cover replaced by `MASK`; spans are in order of start."""
    # The end so far and the pieces so far, joined; overlapping spans are one stretch.
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))

    def add(state: Column, span: Column) -> Column:
        between = F.substr(text, state["end"] + 1, F.greatest(span["start"] - state["end"], F.lit(0)))
        fresh = F.concat(state["out"], between, F.lit(MASK))
        apart = (span["start"] >= state["end"]) & ((span["start"] > state["end"]) | (state["out"] == ""))
        return F.struct(
            F.greatest(state["end"], span["end"]).alias("end"), F.when(apart, fresh).otherwise(state["out"]).alias("out")
        )

    done = F.aggregate(spans, start, add)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substr(text, done["end"] + 1)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; `n_chars` counts the text as it then is."""
    found = scan_secrets(docs, keep=COLUMNS[1:])
    text = masked(F.col("text"), F.col("findings"))
    changed = F.size("findings") > 0
    count = F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", count.alias("n_chars"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their number, digest and the digest of the decoded text."""
    return encode(docs, public_tokenizers.path(VOCABULARY), digested=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("bpe", bpe),
]

#: Learned scores, similarities and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and reread; tables go once read."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{at}-{name}")
        if at:
            scratch.drop(f"{at - 1}-{STAGES[at - 1][0]}")
    return docs
