"""Quality of texts by weak supervision: rules vote or abstain, and what their votes are
worth is estimated from how they agree, without any label.

Counts of a text are the facts, rules turn them into votes (1 for good, -1 against,
0 abstains). A text is good or has a fault of some kind; several rules look for each
kind. Given which, rules vote independently of each other, each with a probability of
its own of being right about good texts and about those of each fault.
Expectation-maximisation finds these probabilities and the share of each kind that
explain the votes of all texts best, within a prior belief that a rule is right. The
posterior probability of good decides: one rule that is often wrong about good texts
does not condemn a text alone, one that is right does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsquant.llm.arrow import map_batches, text_slices
from tsquant.llm.words import split_lines, split_words, sums, text_bytes

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
#: Words of a window whose repetition counts.
WINDOW = 3
#: Fewer words than this, or more than this percentage of them in repeated windows, fail.
LEAST_WORDS, REPEATED_PERCENT = 50, 50
#: Posterior probability of good from which a text is kept.
KEPT_FROM = 0.5

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct",
    "n_bare", "n_letters", "n_upper", "n_marks",
)


def _table(chars: bytes) -> np.ndarray:
    held = np.zeros(256, np.uint8)
    held[list(chars)] = 1
    return held


BLANK = _table(b" \t\n\x0b\x0c\r")
UPPER = _table(bytes(range(65, 91)))
#: Bytes that begin a character, and those that begin a letter (any character beyond ASCII counts).
FIRST = _table(bytes(b for b in range(256) if b & 0xC0 != 0x80))
LETTER = _table(bytes(b for b in range(256) if b >= 0xC0 or chr(b).isalpha() and b < 128))
ALNUM = _table(bytes(b for b in range(256) if b >= 0xC0 or chr(b).isalnum() and b < 128))
CHAR_COUNTS = {
    "word_chars": FIRST & (1 - BLANK),
    "n_symbols": _table(SYMBOLS),
    "n_letters": LETTER,
    "n_upper": UPPER,
    "n_marks": _table(MARKS),
}


def repeated_words(codes: np.ndarray, starts: np.ndarray, kinds: int, window: int = WINDOW) -> np.ndarray:
    """Per text, the words that stand in a window of words found twice or more in it."""
    owners = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    size = len(codes) - window + 1
    covered = np.zeros(len(codes) + 1, np.int64)
    if size > 0:
        # Equal windows of one text get equal names: the text, then word after word.
        names = owners[:size].astype(np.int64)
        for at in range(window):
            names = np.unique(names * kinds + codes[at : at + size], return_inverse=True)[1]
        whole = owners[:size] == owners[window - 1 :]
        found = np.bincount(names[whole], minlength=size)
        first = np.flatnonzero(whole & (found[names] > 1))
        np.add.at(covered, first, 1)
        np.add.at(covered, first + window, -1)
    return sums(np.cumsum(covered)[:-1] > 0, starts)


def count_slice(texts: pa.Array) -> dict[str, np.ndarray]:
    words, lines = split_words(texts), split_lines(texts)
    data, starts = text_bytes(texts)
    n, kinds = len(texts), max(1, len(words.spelled))
    out = {name: sums(table[data], starts) for name, table in CHAR_COUNTS.items()}
    out["n_words"] = np.diff(words.starts)
    out["n_lines"] = np.bincount(lines.owners, minlength=n)
    unlike = np.unique(lines.owners * max(1, len(lines.spelled)) + lines.codes) // max(1, len(lines.spelled))
    out["n_dup_lines"] = out["n_lines"] - np.bincount(unlike, minlength=n)
    owners = np.repeat(np.arange(n), out["n_words"])
    out["n_distinct"] = np.bincount(np.unique(owners * kinds + words.codes) // kinds, minlength=n)
    # Whether a word has a letter or digit is asked of its spelling, once.
    letters, at = text_bytes(words.spelled)
    bare = sums(ALNUM[letters], at) == 0
    out["n_bare"] = sums(bare[words.codes], words.starts) if len(words.codes) else np.zeros(n, np.int64)
    out["n_repeat_words"] = repeated_words(words.codes, words.starts, kinds)
    return out


def quality_counts(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and `COUNTS` (long) of every text: a row for each row of `docs`, in any order.

    Null and empty texts count 0 throughout. Rows with equal or null ids are kept as
    they are; other columns of `docs` are not read, whatever their names. A text of
    any length is counted whole in one task, in some 100 bytes a word.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            counts = count_slice(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(counts[name], pa.int64()) for name in COUNTS]], ["id", *COUNTS]
            )

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    schema = f"id {kind}, " + ", ".join(f"{name} long" for name in COUNTS)
    return map_batches(rows, run, schema).withColumnRenamed("id", id_column)


def over(part: str, percent: float, whole: str) -> Column:
    return F.col(part) * 100 > F.col(whole) * percent


@dataclass(frozen=True)
class Rule:
    """Votes against a text where `bad` holds, else for it where `good` holds, else not at all.

    `fault` names the kind of fault that the rule looks for; rules of one fault look for
    it in different ways.
    """

    name: str
    fault: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        found = F.when(self.bad, F.lit(-1)).when(self.good, F.lit(1)).otherwise(F.lit(0))
        return F.coalesce(found, F.lit(0)).cast("byte").alias(self.name)


def default_rules() -> list[Rule]:
    """Rules over `COUNTS`; shares are of words, lines or characters, in percent."""
    long = F.col("n_words") >= 20
    few_kinds = (F.col("n_words") < 2000) & ~over("n_distinct", 25, "n_words")
    short = F.col("word_chars") < F.col("n_words") * 2
    return [
        Rule("symbols", "noise", over("n_symbols", 10, "n_words"), long & ~over("n_symbols", 3, "n_words")),
        Rule("bare_words", "noise", over("n_bare", 20, "n_words"), long & ~over("n_bare", 5, "n_words")),
        Rule("letters", "noise", long & ~over("n_letters", 75, "word_chars"), over("n_letters", 85, "word_chars")),
        Rule("repeats", "repetition", over("n_repeat_words", 30, "n_words"), long & ~over("n_repeat_words", 15, "n_words")),
        Rule("same_lines", "repetition", over("n_dup_lines", 30, "n_lines"), (F.col("n_lines") > 2) & ~over("n_dup_lines", 10, "n_lines")),
        Rule("variety", "repetition", long & few_kinds, long & over("n_distinct", 40, "n_words")),
        Rule("capitals", "shouting", long & over("n_upper", 40, "n_letters"), long & ~over("n_upper", 15, "n_letters")),
        Rule("marks", "shouting", over("n_marks", 20, "n_words"), long & ~over("n_marks", 5, "n_words")),
        Rule(
            "word_length",
            "shape",
            short | (F.col("word_chars") > F.col("n_words") * 15),
            F.col("word_chars").between(F.col("n_words") * 3, F.col("n_words") * 10),
        ),
        Rule("shortness", "shape", F.col("n_words") < 10, F.col("n_words") >= LEAST_WORDS),
    ]


@dataclass(frozen=True)
class Beliefs:
    """Beta priors as texts seen beforehand, in every 1,000 texts: how many of the votes of a
    rule are against the text and for it, where the text is good, where it has the fault that
    the rule looks for, and where it has another one; how many texts are good and not."""

    of_good: tuple[float, float] = (1.0, 99.0)
    of_own_fault: tuple[float, float] = (6.0, 4.0)
    of_other_fault: tuple[float, float] = (1.0, 9.0)
    good: tuple[float, float] = (90.0, 10.0)


GOOD = "good"


@dataclass(frozen=True)
class Model:
    """`shares`: of the good texts and of those of each fault. `against[kind][rule]`: of the
    votes of a rule on texts of a kind, the part that is against them."""

    shares: dict[str, float]
    against: dict[str, dict[str, float]]

    def accuracy(self, rule: Rule) -> tuple[float, float]:
        """How often a vote of the rule is right about good texts, and about those of its fault."""
        return 1 - self.against[GOOD][rule.name], self.against[rule.fault][rule.name]

    def good(self, votes: np.ndarray, names: list[str]) -> np.ndarray:
        """Posterior probability that a text is good, for rows of votes in the order of names."""
        chance = np.array([[self.against[kind][name] for name in names] for kind in self.shares])
        joint = joint_chances(votes, chance, np.array(list(self.shares.values())))
        return joint[:, list(self.shares).index(GOOD)] / joint.sum(axis=1)


def joint_chances(votes: np.ndarray, chance: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of each row of votes and each kind, in proportion; `chance` of a vote against, by kind and rule."""
    logs = np.log(share) + (votes == -1) @ np.log(chance).T + (votes == 1) @ np.log(1 - chance).T
    return np.exp(logs - logs.max(axis=1, keepdims=True))


def estimate(
    votes: np.ndarray, texts: np.ndarray, rules: list[Rule], beliefs: Beliefs = Beliefs(), rounds: int = 500
) -> Model:
    """Expectation-maximisation over distinct rows of votes and how many texts have each."""
    kinds = [GOOD, *dict.fromkeys(r.fault for r in rules)]
    faults = len(kinds) - 1
    n = max(1.0, texts.sum()) / 1000
    start = [
        [beliefs.of_good if k == GOOD else beliefs.of_own_fault if k == r.fault else beliefs.of_other_fault for r in rules]
        for k in kinds
    ]
    prior = np.array(start) * n  # kind, rule, (against, for)
    whole = np.array([beliefs.good[0], *[beliefs.good[1] / faults] * faults]) * n
    chance, share = prior[..., 0] / prior.sum(axis=2), whole / whole.sum()
    against, held = (votes == -1).astype(float), (votes == 1).astype(float)
    for _ in range(rounds):
        part = joint_chances(votes, chance, share)
        part = part / part.sum(axis=1, keepdims=True) * texts[:, None]
        before = chance, share
        chance = (part.T @ against + prior[..., 0]) / (part.T @ (against + held) + prior.sum(axis=2))
        share = (part.sum(axis=0) + whole) / (texts.sum() + whole.sum())
        if max(np.abs(chance - before[0]).max(), np.abs(share - before[1]).max()) < 1e-10:
            break
    names = [r.name for r in rules]
    return Model(
        dict(zip(kinds, share.tolist())), {k: dict(zip(names, row.tolist())) for k, row in zip(kinds, chance)}
    )


def fit(counts: DataFrame, rules: list[Rule] | None = None, beliefs: Beliefs = Beliefs()) -> Model:
    """What the votes of all texts tell of the rules. Only distinct rows of votes, at most
    3 to the number of rules, come to the driver, with the number of texts of each.

    An empty table gives the prior beliefs.
    """
    rules = default_rules() if rules is None else rules
    names = [r.name for r in rules]
    found = counts.select(*[r.vote() for r in rules]).groupBy(*names).agg(F.count("*").alias("texts")).collect()
    rows = sorted(tuple(r) for r in found)
    table = np.array(rows, np.float64).reshape(len(rows), len(names) + 1)
    return estimate(table[:, :-1], table[:, -1], rules, beliefs)


def base_failed() -> Column:
    few = F.col("n_words") < LEAST_WORDS
    return few | over("n_repeat_words", REPEATED_PERCENT, "n_words")


def judge(counts: DataFrame, model: Model, rules: list[Rule] | None = None, kept_from: float = KEPT_FROM) -> DataFrame:
    """`counts` with `base_failed`, the vote of each rule, `good` (posterior probability, double)
    and `kept` (boolean: not failed, and `good` at least `kept_from`)."""
    rules = default_rules() if rules is None else rules
    taken = {"base_failed", "good", "kept", *(r.name for r in rules)} & set(counts.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} exist")
    names = [r.name for r in rules]
    voted = counts.select("*", base_failed().alias("base_failed"), *[r.vote() for r in rules])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = np.column_stack([batch.column(name).to_numpy() for name in names])
            good = pa.array(model.good(votes, names), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, good], [*batch.schema.names, "good"])

    done = voted.mapInArrow(run, T.StructType([*voted.schema.fields, T.StructField("good", T.DoubleType())]))
    return done.withColumn("kept", ~F.col("base_failed") & (F.col("good") >= kept_from))
