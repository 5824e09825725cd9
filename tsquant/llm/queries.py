"""One query per operator, over whole tables, in the shape that is compared."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsquant.llm import pii, quality, secret_scan, toxicity, warc
from tsquant.llm.bpe import encode
from tsquant.llm.decontaminate import benchmark_hits
from tsquant.llm.embeddings import near_vectors
from tsquant.llm.html_text import extract_text
from tsquant.llm.lexical import ranked_search
from tsquant.llm.minhash import Settings, near_duplicates
from tsquant.llm.pii import find_personal_data
from tsquant.llm.runs import periodic_runs
from tsquant.llm.scratch import Scratch
from tsquant.llm.secret_scan import scan_secrets
from tsquant.llm.spans import joined
from tsquant.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path(VOCABULARY), ids=False, digested=True)


def spans_digest(found: DataFrame, base: tuple[str, ...], column: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    spans = F.col(column)
    own = F.filter(spans, lambda s: s["kind"].isin(*base))
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in base]
    counts = [(F.size(kinds) - n).cast("long").alias(f"n_{k}") for k, n in zip(base, counts)]
    return found.select(
        "doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(spans).alias("spans")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (~toxicity.train_side(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Settings(words=2))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_digest(find_personal_data(table(spark, sf_dir, "documents")), pii.BASE, "spans")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_hits"),
        F.concat_ws(",", F.transform(items, lambda i: i.cast("string"))).alias("item_ids"),
        F.concat_ws(
            ",", F.transform("hits", lambda h: F.concat_ws(":", *[h[c].cast("string") for c in ("item_id", "start", "end", "edits")]))
        ).alias("spans"),
    )


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_digest(scan_secrets(table(spark, sf_dir, "documents")), secret_scan.BASE, "findings")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    warc.write_warc(warc.captures(table(spark, sf_dir, "pages")), scratch.path("archives"))
    found = warc.assemble(warc.read_records(spark, scratch.path("archives"), payloads=False))
    facts = F.col("metadata.text")
    return found.select(
        warc.field(facts, "page-id").cast("long").alias("page_id"),
        "answer.payload_bytes",
        "answer.payload_digest",
        F.col("answer.type").alias("record_type"),
        warc.field(facts, "refers-to-page").cast("long").alias("refers_to"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_echoes(docs: DataFrame) -> DataFrame:
    """Id and text; in one of ten texts, chosen by the id, the words from some place on repeat
    with some period, as the contract of the query has it."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    n, g = F.size(words), F.floor(F.col("h") / 10)
    at = F.pmod(g, n).cast("int")
    period = (F.floor((n - at) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, at + 1, period), F.ceil((n - at) / period).cast("int")))
    echoed = F.concat_ws(" ", F.slice(F.concat(F.slice(words, 1, at), tail), 1, n))
    return chosen.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), echoed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_echoes(table(spark, sf_dir, "documents")), collapse=True)
    runs = F.col("runs")
    longest = F.array_max(
        F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"], r["period"].alias("q")))
    )
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), longest.alias("top"), line.alias("lines"), "collapsed"
    ).select(
        "doc_id",
        "n_runs",
        (-F.col("top")["col2"]).alias("start"),
        F.col("top")["length"].alias("length"),
        F.col("top")["q"].alias("period"),
        F.floor(F.col("top")["length"] * 1000 / F.col("top")["q"]).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("lines", lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = Scratch(spark, "quality").table(quality.quality_counts(table(spark, sf_dir, "documents")), "counts")
    judged = quality.judge(counts, quality.fit(counts))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *shown, "base_failed", "kept", "good")


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_html_text": op5_html_text,
    "op6_pii": op6_pii,
    "op7_decontamination": op7_decontamination,
    "op8_near_vectors": op8_near_vectors,
    "op9_secrets": op9_secrets,
    "op10_warc": op10_warc,
    "op11_lexical_search": op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}
