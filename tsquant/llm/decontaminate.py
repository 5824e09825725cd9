"""Benchmark passages in documents, up to a budget of edits.

Texts are compared as their letters and digits, case folded, with one space for
whatever stands between; so marks, breaks and case are no edits. By the q-gram
lemma, a passage of length m that stands in a text with at most e edits shares at
least T = m - q + 1 - q e of its q-grams with it, on diagonals (place in the text
less place in the passage) that differ by at most e. So

1. places of a text whose q-gram occurs in any passage are marked, and stretches
   whose marks cannot reach T for any passage of about that length are left out;
2. in what remains, shared q-grams are counted for each passage in bands of 2 e
   diagonals, each overlapping half of the next, and bands that reach T are kept;
3. an alignment along the band decides: at most e edits, and where.

All of it runs in the task that holds the text; what is sent there is the index of
the passages, in parts of a bounded size. Each part is a pass over the documents whose
hits are written before the next part is read, so driver and tasks hold one part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsquant.llm.arrow import map_batches, refuse_repeats, text_slices
from tsquant.llm.scratch import Scratch

Q = 10
#: Edits allowed for each character of a passage.
EDITS = 0.06
#: Characters of passages indexed in one pass.
INDEX_CHARS = 2_000_000
#: Places of a text whose shared q-grams are looked at together.
SEGMENT = 1 << 14
FACTOR = np.uint64(0x9E3779B97F4A7C15)

HITS = "array<struct<item_id:long,start:int,end:int,edits:int>>"


WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    return " ".join(WORD.findall(text.casefold()))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q characters in a row, doubled up from shorter ones."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    powers = {1: np.array([0xD6E8FEB86659FD93], np.uint64)}
    size, doubled, out, done = 1, chars + np.uint64(1), None, 0
    while size <= q:
        if q & size:
            count = len(chars) - done - size + 1
            part = doubled[done : done + count] if out is not None else doubled
            out = part if out is None else out[:count] * powers[size] + part
            done += size
        if size * 2 <= q:
            doubled = doubled[:-size] * powers[size] + doubled[size:]
            powers[size * 2] = powers[size] * powers[size]
        size *= 2
    return out


def alignment(passage: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Least edits between the passage and a stretch of the text, within diagonals low to high.

    Returns (edits, start, end) with the least end among the best, or None beyond
    `most` edits. The stretch may start and end at any place of the band.
    """
    width = high - low + 1
    far = len(passage) + len(text) + 1
    steps = np.arange(width)
    where = np.arange(low, high + 1)  # place in the text before each diagonal's next character
    inside = (where >= 0) & (where <= len(text))
    cost = np.where(inside, 0, far)
    start = where.copy()
    padded = np.concatenate([text, [np.uint64(1 << 40)]])
    for i, char in enumerate(passage):
        place = where + i  # character of the text met on each diagonal
        met = (place >= 0) & (place < len(text))
        same = padded[np.where(met, place, -1)] == char
        take = np.where(met, cost + ~same, far)
        skip = np.append(cost[1:], far) + 1  # a character of the passage is missing
        skip = np.where((place >= 0) & (place <= len(text)), skip, far)
        skipped_start = np.append(start[1:], 0)
        fresh = np.minimum(take, skip)
        begun = np.where(take <= skip, start, skipped_start)
        # A character of the text is extra: from any diagonal to the left.
        best = np.minimum.accumulate(fresh - steps)
        run = best + steps
        from_left = run < fresh
        if from_left.any():
            source = np.maximum.accumulate(np.where(fresh - steps == best, steps, 0))
            begun = np.where(from_left, begun[source], begun)
        ends = place + 1
        cost = np.where((ends >= 0) & (ends <= len(text)), np.where(from_left, run, fresh), far)
        start = begun
    at = int(cost.argmin())
    if cost[at] > most:
        return None
    return int(cost[at]), int(start[at]), int(where[at]) + len(passage)


@dataclass
class Passage:
    item: int
    text: str
    chars: np.ndarray
    most: int
    least: int  # shared q-grams that the lemma asks for


class Index:
    """q-grams of passages, with what the lemma asks of each passage."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: float = EDITS):
        self.q = q
        self.passages: list[Passage] = []
        self.short: list[tuple[int, str]] = []
        for item, text in items:
            text = folded(text)
            if len(text) < q:
                if text:
                    self.short.append((item, text))
                continue
            most = min(int(len(text) * edits), (len(text) - q) // q)
            self.passages.append(Passage(item, text, points(text), most, len(text) - q + 1 - q * most))
        codes = [grams(p.chars, q) for p in self.passages]
        all_codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else owner
        order = np.argsort(all_codes, kind="stable")
        self.codes, self.first = np.unique(all_codes[order], return_index=True)
        self.first = np.append(self.first, len(all_codes))
        self.owner, self.place = owner[order], place[order]
        self.shift = np.uint64(64 - max(10, math.ceil(math.log2(64 * (len(self.codes) + 1)))))
        self.marks = np.zeros(1 << (64 - int(self.shift)), bool)
        self.marks[(self.codes * FACTOR) >> self.shift] = True
        self.widest = max((len(p.text) + 2 * p.most for p in self.passages), default=0)
        # Passages of about one length: the widest stretch, the fewest q-grams.
        classes: dict[int, tuple[int, int]] = {}
        for p in self.passages:
            key = int(math.log(len(p.text), 1.2))
            wide, least = classes.get(key, (0, 1 << 60))
            classes[key] = max(wide, len(p.text) + p.most - q + 1), min(least, p.least)
        self.classes = sorted(set(classes.values()))
        self.most = np.array([p.most for p in self.passages], np.int64)
        self.least = np.array([p.least for p in self.passages], np.int64)

    def marked(self, codes: np.ndarray) -> np.ndarray:
        """How many of the q-grams before each place may be one of the passages'."""
        found = self.marks[(codes * FACTOR) >> self.shift]
        return np.concatenate([np.zeros(1, np.int32), np.cumsum(found, dtype=np.int32)])

    def stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Parts of the q-grams of a text in which some passage may reach its count."""
        total, size = self.marked(codes), len(codes)
        change = np.zeros(size + 1, np.int32)
        for wide, least in self.classes:
            if size <= wide:
                found = np.flatnonzero(total[-1:] >= least)
            else:
                found = np.flatnonzero(total[wide:] - total[:-wide] >= least)
            if len(found):
                edges = np.flatnonzero(np.diff(found) > wide)
                firsts, lasts = found[np.append(0, edges + 1)], found[np.append(edges, len(found) - 1)]
                np.add.at(change, firsts, 1)
                np.add.at(change, np.minimum(lasts + wide, size), -1)
        inside = np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)])
        turns = np.flatnonzero(np.diff(inside))
        return [(int(a), int(b)) for a, b in zip(turns[::2], turns[1::2])]

    def may_hit(self, texts: list[str]) -> np.ndarray:
        """Which of many folded texts have a stretch, from one pass over all of them."""
        if not texts or not self.passages:
            return np.zeros(len(texts), bool)
        ends = np.cumsum([len(t) + 1 for t in texts])
        codes = grams(points("\x00".join(texts)), self.q)
        stretches = np.array(self.stretches(codes), np.int64).reshape(-1, 2)
        # A text is in question if a stretch reaches into it.
        first = np.searchsorted(ends, stretches[:, 0], "right")
        last = np.minimum(np.searchsorted(ends, stretches[:, 1] - 1, "right"), len(texts) - 1)
        change = np.zeros(len(texts) + 1, np.int64)
        np.add.at(change, np.minimum(first, len(texts) - 1), 1)
        np.add.at(change, last + 1, -1)
        return np.cumsum(change[:-1]) > 0

    def bands(self, codes: np.ndarray, start: int) -> set[tuple[int, int]]:
        """(passage, band) with enough shared q-grams; `start` is the place of the first code."""
        found = np.searchsorted(self.codes, codes)
        found[found == len(self.codes)] = 0
        at = np.flatnonzero(self.codes[found] == codes)
        first, last = self.first[found[at]], self.first[found[at] + 1]
        count = last - first
        posting = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        owner, place = self.owner[posting], self.place[posting]
        diagonal = np.repeat(at + start, count) - place
        step = self.most[owner] + 1
        band = diagonal // step
        out: set[tuple[int, int]] = set()
        for shift in (0, 1):  # every diagonal lies in its own band and in the one before
            keys = np.stack([owner, band - shift, place], axis=1)
            keys = np.unique(keys, axis=0)
            pairs, counts = np.unique(keys[:, :2], axis=0, return_counts=True)
            enough = counts >= self.least[pairs[:, 0]]
            out.update(map(tuple, pairs[enough].tolist()))
        return out

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in the folded text, one for each band's best stretch."""
        padded = f" {text} "
        out = {(item, at, at + len(word), 0) for item, word in self.short for at in occurrences(padded, f" {word} ")}
        chars = points(text)
        codes = grams(chars, self.q)
        if len(codes) and self.passages:
            candidates: set[tuple[int, int]] = set()
            for a, b in self.stretches(codes):
                for start in range(a, b, SEGMENT):
                    candidates |= self.bands(codes[start : min(b, start + SEGMENT + self.widest)], start)
            whole = {n: [*occurrences(text, self.passages[n].text)] for n in {n for n, _ in candidates}}
            for number, band in candidates:
                p = self.passages[number]
                low = band * (p.most + 1) - p.most
                high = (band + 2) * (p.most + 1) - 1 + p.most
                equal = next((at for at in whole[number] if low <= at <= high), None)
                if equal is not None:  # no alignment of the band is better
                    out.add((p.item, equal, equal + len(p.text), 0))
                    continue
                base = max(0, low)
                found = alignment(p.chars, chars[base : high + len(p.chars) + 1], low - base, high - base, p.most)
                if found:
                    out.add((p.item, base + found[1], base + found[2], found[0]))
        return best(out)


def occurrences(text: str, word: str) -> Iterator[int]:
    at = text.find(word)
    while at >= 0:
        yield at
        at = text.find(word, at + 1)


def best(hits: set[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping hits of one item the one with the fewest edits, then the first."""
    out: list[tuple[int, int, int, int]] = []
    for item, start, end, edits in sorted(hits, key=lambda h: (h[0], h[3], h[1], h[2])):
        if not any(o[0] == item and start < o[2] and o[1] < end for o in reversed(out) if o[0] == item):
            out.append((item, start, end, edits))
    return sorted(out, key=lambda h: (h[1], h[0], h[2]))


def unfolded(text: str, hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The hits in places of the text as it is."""
    if not hits:
        return hits
    origin: list[int] = []
    gap = False
    for at, char in enumerate(text):
        for part in char.casefold():
            if part.isalnum():
                if gap:
                    origin.append(at - 1)
                    gap = False
                origin.append(at)
            else:
                gap = bool(origin)
    return [(item, origin[a], origin[b - 1] + 1, edits) for item, a, b, edits in hits if b > a]


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    q: int = Q,
    edits: float = EDITS,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    passage_column: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Passages of a benchmark that stand in documents with few edits.

    Returns the id column, the columns of `keep` unchanged and `hits`, an array of
    (item_id, start, end, edits) in order of start: code points of the text as given,
    end exclusive. One row for each row of `docs`, repeated and null ids included; other
    columns are not read. A null or empty text has no hits, and neither has a null or
    blank passage; a passage shorter than `q` is searched without edits, as whole words.
    Repeated passages are separate items.
    """
    refuse_repeats([id_column, *keep, "hits"])
    names = [f"k{i}" for i in range(len(keep) + 1)]
    items = benchmark.select(
        benchmark[item_column].cast("long").alias("item"), benchmark[passage_column].alias("passage")
    ).where("item IS NOT NULL AND trim(passage) <> ''")
    chars = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    parts = max(1, math.ceil(chars / INDEX_CHARS))
    kept = [docs[name].alias(k) for k, name in zip(names, (id_column, *keep))]
    rows = docs.select(docs[text_column].alias("text"), *kept)

    def indexed(part: int) -> Index:
        own = items.where(F.pmod(F.xxhash64("item", "passage"), F.lit(parts)) == part).distinct()
        return Index([(r.item, r.passage) for r in own.collect()], q, edits)

    if parts == 1:
        found = marked(rows, indexed(0))
    else:
        scratch = Scratch(docs.sparkSession, "decontaminate")
        rows = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        tables = []
        for part in range(parts):
            hits = marked(rows.select("text", "row"), indexed(part)).where(F.size("hits") > 0)
            tables.append(scratch.table(hits.select("row", "hits"), f"hits-{part}"))
        hits = reduce(DataFrame.unionByName, tables).select("row", F.explode("hits").alias("hit"))
        order = F.struct("hit.start", "hit.item_id", "hit.end", "hit.edits")
        hits = hits.groupBy("row").agg(F.sort_array(F.collect_list(order)).alias("sorted"))
        whole = F.transform("sorted", lambda h: F.struct(h["item_id"], h["start"], h["end"], h["edits"]))
        hits = hits.select("row", whole.alias("hits"))
        found = rows.drop("text").join(hits, "row", "left")
        found = found.withColumn("hits", F.coalesce("hits", F.array().cast(HITS)))
    return found.select(*names, "hits").toDF(id_column, *keep, "hits")


def marked(rows: DataFrame, index: Index) -> DataFrame:
    """The rows without their `text`, the first column, and with the `hits` of it."""
    fields = rows.schema.fields[1:]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + f", hits {HITS}"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_ in text_slices(batches):
            texts = slice_.column(0).to_pylist()
            plain = [folded(text or "") for text in texts]
            likely = index.may_hit(plain)
            hits: list[list[dict]] = [[] for _ in plain]
            for at, text in enumerate(plain):
                if text and (likely[at] or index.short):
                    found = unfolded(texts[at], index.hits(text))
                    found = [dict(zip(("item_id", "start", "end", "edits"), hit)) for hit in found]
                    hits[at] = sorted(found, key=lambda h: (h["start"], h["item_id"], h["end"]))
            yield pa.RecordBatch.from_arrays([*slice_.columns[1:], pa.array(hits, kind)], [*slice_.schema.names[1:], "hits"])

    return map_batches(rows, run, schema)
