"""Toxicity of documents, after undoing disguises with a noisy channel.

1. Counts of three letters in a row over all documents make a character language
   model; its table is bounded by the alphabet.
2. Words that look disguised (digits or signs for letters, letters set apart, letters
   repeated) become lattices: for every place the letters that may have been meant,
   with what the disguise costs. The best path under costs and model is the word that
   is scored instead, beside the words that need no restoring.
3. A bounded sample of labelled documents gives weights: the log-odds of words between
   toxic and clean documents, for toxic ones also of beginnings of words that no clean
   document has. What counts is in how many different surroundings a word stands, so
   that copies of one text teach no more than the text. Only clear evidence is kept.
4. A weight is the bound nearer to zero of the log-odds, above it for words of toxic
   and below it for words of clean documents. So few sightings weigh little, and one
   word decides alone only if its bound outweighs the prior.
5. The score is the logistic of the prior log-odds and the weights of the distinct
   words of a document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsquant.llm.arrow import TwoGenerations, held, map_batches, refuse_repeats, text_slices
from tsquant.llm.scratch import Scratch

#: Labelled documents of each class that weights are learned from, at most.
SAMPLE = 6000
#: Weights kept, at most, those of the strongest evidence.
FEATURES = 50_000
#: Surroundings a word needs among the documents of its class.
LEAST_SEEN = 4
#: Deviations of the log-odds between their estimate and the bound that counts (one-sided 95%).
DEVIATIONS = 1.645
#: Sightings a task counts before it hands them on.
SIGHTINGS = 200_000
#: Chance that any word at all passes as evidence by accident.
ACCIDENT = 0.01
#: Beginnings of words that are evidence of their own.
PREFIXES = (4, 5, 6, 7)
#: Words a Python worker remembers in each of two generations.
WORDS = 100_000
#: Longest run of signs taken as one word in disguise.
DISGUISE_CHARS = 200

LETTERS = 27  # a to z after a class for all else
# Letters that digits and signs are used for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
}
MARKS = "!¡|+"  # after a word rather punctuation
APART = " .-_*~'·"
LOOKALIKE_COST, NO_LETTER_COST, DROP_COST, BREAK_COST = 1.0, 8.0, 0.3, 1.5
DOUBLE_COST, SINGLE_OF_TWO_COST, SINGLE_OF_MORE_COST = 0.1, 2.0, 0.5

WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.escape("".join(c for c in LOOKALIKES if not c.isdigit()))
_LETTER = r"[^\W\d_]"
DISGUISED = re.compile(
    rf"{_LETTER}[0-9{_SIGN}.\-_*~'·]+{_LETTER}"  # signs between letters
    rf"|(?<!\S)[0-9{_SIGN}]{_LETTER}{_LETTER}"  # a sign for the first letter
    rf"|({_LETTER})\1\1"  # repetition
    rf"|(?<!\S){_LETTER}(?:[ ]{_LETTER}){{2,}}(?!\S)"  # letters set apart
)


def _fold_table() -> bytes:
    """Classes of the characters of Latin-1: letters without accents, 0 for the rest."""
    import unicodedata

    table = bytearray(256)
    for code in range(256):
        base = unicodedata.normalize("NFD", chr(code).lower())[0]
        table[code] = ord(base) - 96 if "a" <= base <= "z" else 0
    return bytes(table)


FOLD = _fold_table()


def classes(text: str) -> bytes:
    return text.encode("latin-1", "replace").translate(FOLD)


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts of (id, text): three neighbouring classes as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for part in text_slices(batches):
            joined = b"\0\0".join(classes(text) for text in part.column(1).to_pylist() if text)
            seen = np.frombuffer(b"\0" + joined + b"\0", np.uint8).astype(np.int32)
            if len(seen) > 2:
                total += np.bincount((seen[:-2] * LETTERS + seen[1:-1]) * LETTERS + seen[2:], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["gram", "n"])

    return map_batches(docs, run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log-probabilities of a class after two others, smoothed by shorter histories."""

    def __init__(self, counts: dict[int, int]):
        three = np.zeros(LETTERS**3)
        for gram, n in counts.items():
            three[gram] = n
        three = three.reshape((LETTERS,) * 3)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + LETTERS)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        self.log = np.log((three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)).tolist()


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, what may have been meant: (letters, cost)."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(word):
        char, end = word[at], at + 1
        while end < len(word) and word[end] == char:
            end += 1
        run = end - at
        at = end
        if char in APART:
            out.append([("", DROP_COST), (" ", BREAK_COST)])
        elif char in LOOKALIKES:
            choices = [(letter, LOOKALIKE_COST) for letter in LOOKALIKES[char]]
            none = DROP_COST if at == len(word) and char in MARKS else NO_LETTER_COST
            out.append([*choices, *((c * 2, cost) for c, cost in choices if run > 1), (" ", none)])
        elif char.isalpha() and run > 1:
            out.append([(char, SINGLE_OF_TWO_COST if run == 2 else SINGLE_OF_MORE_COST), (char * 2, DOUBLE_COST)])
        elif char.isalpha():
            out.append([(char, 0.0)])
        else:
            out.append([(" ", DOUBLE_COST)])
    return out


def restore(word: str, model: LanguageModel) -> str:
    """The likeliest plain text of a disguised word: Viterbi over its lattice."""
    log = model.log
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in lattice(word):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for letters, cost in choices:
                x, y, total, trace = a, b, score - cost, path
                for letter in letters:
                    z = classes(letter)[0]
                    total += log[x][y][z]
                    x, y, trace = y, z, (trace, letter)
                held = after.get((x, y))
                if held is None or held[0] < total:
                    after[x, y] = total, trace
        states = after
    best = max(states.items(), key=lambda s: s[1][0] + log[s[0][0]][s[0][1]][0])[1][1]
    letters = []
    while best is not None:
        best, letter = best
        letters.append(letter)
    return "".join(reversed(letters))


def disguised(text: str) -> list[str]:
    """Stretches between spaces that hold a disguise, or letters set apart by spaces."""
    out = []
    done = 0
    for match in DISGUISED.finditer(text):
        start, end = match.span()
        if start < done:
            continue
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        done = end
        # A longer run is cut; a word in disguise has less.
        out += [text[at : min(end, at + DISGUISE_CHARS)] for at in range(start, end, DISGUISE_CHARS)]
    return out


@dataclass
class Reader:
    """Words of texts with their disguises undone, under one language model."""

    model: LanguageModel
    memo: TwoGenerations = field(init=False)

    def __post_init__(self) -> None:
        self.memo = TwoGenerations(lambda found: [WORD.findall(restore(w, self.model)) for w in found], WORDS // 4)

    def extra(self, texts: list[str]) -> list[list[str]]:
        """Restored words of each text (lower case)."""
        found = [disguised(text) for text in texts]
        known = self.memo.of([w for words in found for w in words])
        return [[plain for w in words for plain in known[w]] for words in found]


def features(word: str) -> list[str]:
    """A word and its beginnings; those are marked with a star."""
    return [word, *(word[:size] + "*" for size in PREFIXES if len(word) > size)]


@dataclass
class Model:
    """What `fit` learns; small enough to travel with every task."""

    trigrams: dict[int, int]
    weights: dict[str, float]
    prior: float

    @property
    def key(self) -> tuple:
        return self.prior, len(self.weights), sum(self.weights.values()), sum(self.trigrams.values())


def train_side(id_column: Column) -> Column:
    """Whether labels of a document may be learned from: crc32 of its id mod 3 is not 1."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample: int = SAMPLE,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Model:
    """Learns the language model from all documents, and weights from labelled ones.

    Labels are used of ids on the train side only (`train_side`), of `sample` ids of
    each class at most, taken in order of a hash. An id with several labels counts
    as toxic if one says so; null labels and null ids are left out. Without documents
    of both classes there are no weights, and the prior is that of the labels seen.
    """
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    trigrams = {r.gram: r.n for r in count_trigrams(rows).collect()}  # 27**3 rows at most
    known = labels.select(labels[id_column].alias("id"), labels[label_column].cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull() & train_side(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic > 0: r["count"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    prior = math.log((bad + 0.5) / (good + 0.5))
    if not bad or not good:
        return Model(trigrams, {}, prior)
    order = F.xxhash64("id"), F.col("id")
    chosen = {t: known.where((F.col("toxic") > 0) == t).orderBy(*order).limit(sample).select("id") for t in (True, False)}
    toxic = rows.join(F.broadcast(chosen[True]), "id", "left_semi")  # `sample` ids at most
    clean = rows.join(F.broadcast(chosen[False]), "id", "left_semi")
    reader = LanguageModel(trigrams)

    def surroundings(beginnings: bool):
        """Where words stand first; beginnings too, or only how many documents have them."""

        def handed_on(seen: Counter) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(seen), 50_000):
                part = [*seen.items()][start : start + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*((*k, n) for k, n in part)), (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                    ["name", "before", "after", "n"],
                )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Reader(reader)
            seen: Counter = Counter()
            for part in text_slices(batches):
                texts = [text or "" for text in part.column(1).to_pylist()]
                for text, extra in zip(texts, own.extra(texts), strict=True):
                    words = WORD.findall(text.lower())
                    first: dict[str, tuple[int, int]] = {}
                    for at, word in enumerate(words):
                        for name in features(word) if beginnings else (word,):
                            if name not in first:
                                before, after = words[at - 1] if at else "", words[at + 1] if at + 1 < len(words) else ""
                                first[name] = crc32(before.encode()), crc32(after.encode())
                    for word in extra:
                        for name in features(word.lower()) if beginnings else (word.lower(),):
                            first.setdefault(name, (crc32(text[:200].encode()), crc32(text[-200:].encode())))
                    if not beginnings:
                        first.update({name: (0, 0) for word in [*first] for name in features(word)[1:]})
                    seen.update((name, *place) for name, place in first.items())
                    if len(seen) >= SIGHTINGS:
                        yield from handed_on(seen)
                        seen.clear()
            yield from handed_on(seen)

        return run

    kind = "name string, before long, after long, n long"
    sides = [
        map_batches(rows, surroundings(side), kind).withColumn("toxic", F.lit(side)) for rows, side in ((toxic, True), (clean, False))
    ]
    scratch = Scratch(docs.sparkSession, "toxicity")
    places = sides[0].union(sides[1]).groupBy("toxic", "name", "before", "after").agg(F.sum("n").alias("n"))
    places = scratch.table(places, "places")
    usual = F.max_by(F.struct("before", "after"), F.struct("n", "before", "after"))
    by_name = places.groupBy("toxic", "name").agg(usual.alias("usual"), F.count(F.lit(1)).alias("places"), F.sum("n").alias("docs"))
    often = by_name.where(F.col("places") >= LEAST_SEEN).select("toxic", "name", "usual")
    # Copies of a text change one neighbour at a time; a place of its own differs in both.
    own_place = (F.col("before") != F.col("usual.before")) & (F.col("after") != F.col("usual.after"))
    novel = places.join(often, ["toxic", "name"]).where(own_place).groupBy("toxic", "name").agg(F.count(F.lit(1)).alias("n"))
    novel = novel.where(F.col("n") + 1 >= LEAST_SEEN)
    other = by_name.select((~F.col("toxic")).alias("toxic"), "name", F.col("docs").alias("other"))
    found = novel.join(other, ["toxic", "name"], "left").select("toxic", "name", F.col("n") + 1, F.coalesce("other", F.lit(0)))
    found = scratch.table(found.toDF("toxic", "name", "n", "other"), "evidence")
    scratch.drop("places")
    clear = math.log(max(found.count(), 1) / ACCIDENT)
    bad, good = min(bad, sample), min(good, sample)
    size, rest = (F.when(F.col("toxic"), a).otherwise(b).cast("double") for a, b in ((bad, good), (good, bad)))
    found = found.withColumns({"n": F.least(F.col("n").cast("double"), size), "other": F.least(F.col("other").cast("double"), rest)})
    found = found.withColumn("bound", log_odds_bound(F.col("n"), size, F.col("other"), rest))
    found = found.where((F.col("bound") > 0) & (surprise(F.col("n"), F.col("other"), size / (size + rest)) >= clear))
    # A beginning of words of clean documents is no evidence of its own.
    found = found.where(~(F.col("name").endswith("*") & (F.col("other") > 0)))
    found = found.orderBy(F.desc("bound"), "name").limit(FEATURES)
    weights = {r.name: r.bound if r.toxic else -r.bound for r in found.collect()}
    scratch.drop("evidence")
    return Model(trigrams, weights, prior)


def log_odds_bound(n: Column, size: Column, other: Column, rest: Column) -> Column:
    """Lower bound of the log-odds of `n` among `size` documents against `other` among `rest`."""
    estimate = F.log((n + 0.5) / (size + 1)) - F.log((other + 0.5) / (rest + 1))
    return estimate - DEVIATIONS * F.sqrt(1 / (n + 0.5) - 1 / (size + 1) + 1 / (other + 0.5) - 1 / (rest + 1))


def surprise(n: Column, other: Column, share: Column) -> Column:
    """Bound on -log of the chance that n of n + other draws are of the class, which has that share."""
    seen = n / (n + other)
    unseen = F.when(other > 0, (1 - seen) * F.log((1 - seen) / (1 - share))).otherwise(0.0)
    return (n + other) * (seen * F.log(seen / share) + unseen)


class Scorer:
    """Scores texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.reader = Reader(LanguageModel(model.trigrams))
        weights = model.weights
        best = lambda word: max((weights[name] for name in features(word) if name in weights), default=0.0)
        self.memo = TwoGenerations(lambda words: [best(word) for word in words], WORDS)

    def scores(self, texts: list[str]) -> list[float]:
        words = [{*WORD.findall(text.lower())} for text in texts]
        for own, extra in zip(words, self.reader.extra(texts), strict=True):
            own.update(word.lower() for word in extra)
        known = self.memo.of([word for own in words for word in own])
        evidence = [math.fsum(map(known.__getitem__, own)) for own in words]
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, e + self.model.prior)))) for e in evidence]


def scorer(model: Model) -> Scorer:
    """The scorer of a model, kept by the Python worker."""
    return held(("toxicity", model.key), lambda: Scorer(model))


def score(
    docs: DataFrame,
    model: Model,
    *,
    threshold: float = 0.7,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Scores every whole text with a model from `fit`.

    Returns the id column, the columns of `keep` unchanged, `score` (0 to 1) and
    `predicted` (1 from `threshold` on): one row for each row of `docs`, repeated and
    null ids included; other columns are not read. A null or empty text has the score
    of the prior.
    """
    refuse_repeats([id_column, *keep, "score", "predicted"])
    kinds = [docs.schema[name].dataType.simpleString() for name in (id_column, *keep)]
    names = [f"k{i}" for i in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(model)
        for part in text_slices(batches):
            scores = own.scores([text or "" for text in part.column(0).to_pylist()])
            marks = pa.array([int(s >= threshold) for s in scores], pa.int32())
            out = [*part.columns[1:], pa.array(scores, pa.float64()), marks]
            yield pa.RecordBatch.from_arrays(out, [*names, "score", "predicted"])

    kept = [docs[name].alias(k) for k, name in zip(names, (id_column, *keep))]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", score double, predicted int"
    rows = map_batches(docs.select(docs[text_column].alias("text"), *kept), run, schema)
    return rows.toDF(id_column, *keep, "score", "predicted")
