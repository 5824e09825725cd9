"""Secrets: every distinct blob is scanned once per rule version, paths share findings.

A version is one row (path, text). Its blob is named by the SHA-256 of its content.
The ledger is a Parquet table with one row for each scanned pair of blob and rule
version, with or without findings; a run scans only pairs that it does not hold,
appends them, and joins the ledger back to all paths. Column expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsquant.llm.arrow import refuse_repeats
from tsquant.llm.scratch import Scratch
from tsquant.llm.spans import with_spans

FINDINGS = "array<struct<start:int,rank:int,end:int,kind:string>>"
LEDGER = f"blob string, rule string, version int, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A new `version` makes the rule be run on all blobs again."""

    kind: str
    pattern: str
    least: int
    version: int = 1
    part: str | None = None  # what of the match must have `least` characters; None: all
    free: str | None = None  # characters that must not stand next to the match


# Lengths are checked on whole matches, so a match that fails still uses up its text.
# Runs of hex digits are taken whole by either form; the shorter ones are left out.
RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        6,
        part=r"""(?i:^(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?""",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, free="[A-Za-z0-9_-]"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)
BASE = ("assign", "access", "hex")
# What a text with a match contains, for a cheap test before the search.
GATES = {
    "assign": "(?i)password|passwd|secret|token|api_?key",
    "access": "AKIA",
    "hex": "[0-9a-f]{24}",
    "hosting": "gh[pousr]_",
    "payment": "k_live_",
    "chat": "xox",
    "webtoken": "eyJ",
    "private_key": "PRIVATE KEY",
}


def _passes(rule: Rule, s: Column) -> Column:
    match = s["match"]
    counted = match if rule.part is None else F.regexp_replace(match, rule.part, "")
    passes = F.length(counted) >= rule.least
    if rule.free:
        passes = passes & ~s["before"].rlike(rule.free) & ~s["after"].rlike(rule.free)
    return passes


def _of_rule(rule: Rule, rank: int) -> Column:
    def named(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")
        )

    found = F.transform(F.filter(F.col(f"_{rule.kind}"), lambda s: _passes(rule, s)), named)
    return F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), found.alias("findings"))


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `findings` for each rule to rows (blob, text): columns blob, rule, version, findings.

    A null text has none. Ranks are the places in `RULES`.
    """
    kinds = [rule.kind for rule in RULES]
    gates = {r.kind: F.col("text").rlike(GATES[r.kind]) if r.kind in GATES else None for r in rules}
    rows = with_spans(blobs.select("blob", "text"), "text", {r.kind: (r.pattern, gates[r.kind]) for r in rules})
    each = [_of_rule(rule, kinds.index(rule.kind) if rule.kind in kinds else len(kinds)) for rule in rules]
    return rows.select("blob", F.inline(F.array(*each)))


class Ledger:
    """The table of scanned pairs at a path; it may not exist yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return place.getFileSystem(conf).exists(place)

    def pairs_of(self, rules: tuple[Rule, ...]) -> DataFrame:
        """Rows of the ledger for these rules in these versions."""
        wanted = [(F.col("rule") == r.kind) & (F.col("version") == r.version) for r in rules]
        return self.spark.read.schema(LEDGER).parquet(self.path).where(reduce(Column.__or__, wanted))

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def one_of_each(rows: DataFrame) -> DataFrame:
    """One row (blob, text) for each blob; copies within a task go before the exchange."""
    return rows.select("blob", "text").dropDuplicates(["blob"])


def unscanned(rows: DataFrame, ledger: Ledger, rules: tuple[Rule, ...]) -> list[tuple[tuple[Rule, ...], DataFrame]]:
    """Rows of blobs the ledger lacks, by the rules it lacks for them.

    There are as many parts as different sets of rules the ledger holds for a blob:
    one for a new ledger, and no more than rules or versions were added one by one.
    """
    named = rows.where(F.col("blob").isNotNull())
    if not ledger.exists():
        return [(rules, named)]
    held = ledger.pairs_of(rules).groupBy("blob").agg(F.array_sort(F.collect_set("rule")).alias("held"))
    parts = [(rules, named.join(held, "blob", "left_anti"))]
    for row in held.select("held").distinct().collect():
        lack = tuple(r for r in rules if r.kind not in row.held)
        if lack:
            same = F.col("held") == F.array(*map(F.lit, row.held))
            parts.append((lack, named.join(held.where(same), "blob", "left_semi")))
    return parts


def scan_secrets(
    versions: DataFrame,
    ledger_path: str | None = None,
    *,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Secrets of every version of every path, scanning only what the ledger lacks.

    Returns the id column, the columns of `keep` unchanged and `findings`, an array of
    (start, rank, end, kind) in order of start and of the rules: one row for each row of `versions`, repeated and
    null ids included; other columns are not read. A null or empty text has none.
    Without a `ledger_path` the ledger is new and lies in the shared folder.
    """
    refuse_repeats([id_column, *keep, "findings"])
    spark = versions.sparkSession
    ledger = Ledger(spark, ledger_path or Scratch(spark, "secrets").path("ledger"))
    rows = versions.select(versions[text_column].alias("text")).withColumn("blob", F.sha2("text", 256))
    for lack, todo in unscanned(rows, ledger, rules):
        ledger.append(findings(one_of_each(todo), lack))
    # Two runs that scan at once may both add a pair; it counts once.
    by_blob = (
        ledger.pairs_of(rules)
        .where(F.size("findings") > 0)
        .groupBy("blob", "rule", "version")
        .agg(F.first("findings").alias("findings"))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("findings"))
    )
    names = [f"k{i}" for i in range(len(keep) + 1)]
    kept = [versions[name].alias(k) for k, name in zip(names, (id_column, *keep))]
    paths = versions.select(F.sha2(versions[text_column], 256).alias("blob"), *kept)
    out = paths.join(by_blob, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))
    return out.select(*names, "findings").toDF(id_column, *keep, "findings")
