"""Runs: stretches of words that repeat with a period, found by internal pattern matching.

The words of many texts stand on end, each text with words and an end mark of its own, so
that nothing matches across texts. Doubling lengths give every factor of 1, 2, 4 ... words a
name, and the suffix array; a level of names is kept as long as any factor of its length
occurs twice.

A run of period q and length L holds a block, that is a factor of 2^k words at a multiple
of 2^k, together with its copy q words on, if 2^(k+1) - 1 <= L - q. So each block asks
where it occurs in the windows behind it, of as many starts as it has words: its places in
the suffix array are one range, and range successors and predecessors in a wavelet tree
over the array give the first two and the last occurrence in a window. Occurrences of a
factor in such a window form one progression, so these three are all of them; each
distance from the block is a candidate period. Names of falling length extend a candidate
to both sides as far as words q apart are equal.

Occurrences within one stretch of the progression's own difference p repeat what p gives
and are left out. Candidates of one stretch keep the least period, the others being its
multiples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tsquant.llm.arrow import map_batches, text_slices
from tsquant.llm.wavelet import WaveletMatrix
from tsquant.llm.words import Words, split_words

#: Fixed by the definition: least words of a run, and least number of its periods.
LEAST, TIMES = 12, 2


class Factors(NamedTuple):
    """`names[k][i]`: the first place in the suffix array of the factors equal to the one of
    2^k words at i; `suffixes`: the array. The last level is that of the longest factors
    of such lengths that occur twice."""

    names: list[np.ndarray]
    suffixes: np.ndarray


def factors(letters: np.ndarray) -> Factors:
    """Doubles lengths until every factor is unique; only those that are not are sorted again."""
    size = len(letters)
    suffixes = np.argsort(letters, kind="stable")
    sorted_letters = letters[suffixes]
    fresh = np.concatenate(([True], sorted_letters[1:] != sorted_letters[:-1])) if size else np.zeros(0, bool)
    name = np.empty(size, np.int64)
    name[suffixes] = np.maximum.accumulate(np.where(fresh, np.arange(size), 0))
    names, length = [], 1
    while True:
        # Places of the array whose factors occur twice; equal ones are neighbours.
        held = name[suffixes]
        first = held == np.arange(size)
        alone = first & np.concatenate((first[1:], [True]))
        places = np.flatnonzero(~alone)
        if not len(places):
            return Factors(names, suffixes)
        names.append(name.astype(np.int32 if size < 2**31 else np.int64))
        starts = suffixes[places]
        # A factor that occurs twice does not reach the end mark, so it has a successor.
        keys = name[starts] * size + name[starts + length]
        order = np.argsort(keys, kind="stable")
        keys, starts = keys[order], starts[order]
        suffixes[places] = starts
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        name = name.copy()
        name[starts] = np.maximum.accumulate(np.where(fresh, places, 0))
        length *= 2


def reach(names: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many words from left on equal those from right on."""
    total = np.zeros(len(left), np.int64)
    for level in range(len(names) - 1, -1, -1):
        same = names[level][left + total] == names[level][right + total]
        total += same.astype(np.int64) << level
    return total


def reach_back(names: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many words before left equal those before right; left is less than right."""
    total = np.zeros(len(left), np.int64)
    for level in range(len(names) - 1, -1, -1):
        a, b = left - total - (1 << level), right - total - (1 << level)
        same = (a >= 0) & (names[level][np.maximum(a, 0)] == names[level][np.maximum(b, 0)])
        total += same.astype(np.int64) << level
    return total


def windows(level: int) -> tuple[int, list[tuple[int, int]]]:
    """The stride of the blocks of a level, and the distances that each of its windows covers.

    Level 2 stands for all shorter ones too, since runs have 12 words: of those with a
    period up to 14 the part that recurs has 6 words or more, and of any three
    neighbouring starts one is even.
    """
    size = 1 << level
    if level == 2:
        return 2, [(1, 4), (5, 8), (9, 12), (13, 14)]
    first = 2 * size - 1
    return size, [(first, first + size - 1), (first + size, first + 2 * size - 1)]


def candidates(found: Factors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, the distances at which they occur again, and their lengths."""
    names, suffixes = found
    none = np.zeros(0, np.int64)
    blocks, distances, lengths = [none], [none], [none]
    if len(names) < 3:
        return none, none, none
    size = len(suffixes)
    # Only factors of four words that occur twice are ever asked for.
    twice = np.bincount(names[2], minlength=size)[names[2][suffixes]] > 1
    place = np.concatenate(([0], np.cumsum(twice)))
    tree = WaveletMatrix(suffixes[twice])
    for level in range(2, len(names)):
        stride, spans = windows(level)
        block = np.arange(0, size, stride)
        group = names[level][block]
        many = np.bincount(names[level], minlength=size)[group]
        block, group, many = (x[many > 1].astype(np.int64) for x in (block, group, many))
        low, high = place[group], place[group + many]
        length = 1 << level
        for nearest, farthest in spans:
            before = tree.below(low, high, block + nearest)
            count = tree.below(low, high, block + farthest + 1) - before
            at = np.flatnonzero(count > 0)
            b, lo, hi, skip, n = block[at], low[at], high[at], before[at], count[at]
            first = tree.ranked(lo, hi, skip)
            step, kept_from = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            several = np.flatnonzero(n > 1)
            step[several] = tree.ranked(lo[several], hi[several], skip[several] + 1) - first[several]
            row = np.flatnonzero(n > 2)
            last = tree.ranked(lo[row], hi[row], skip[row] + n[row] - 1)
            if np.any(last - first[row] != step[row] * (n[row] - 1)):
                raise AssertionError("occurrences in a window are one progression")
            # Of three or more, the difference is a period of the block: those that end
            # within the block's own stretch of that period are its multiples.
            end = b[row] + length
            end = end + reach(names, end - step[row], end)
            inside = np.where(first[row] + length <= end, (end - length - first[row]) // step[row] + 1, 0)
            kept_from[row] = np.minimum(inside, n[row])
            each = n - kept_from
            owner = np.repeat(np.arange(len(at)), each)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + kept_from[owner]
            blocks.append(b[owner])
            distances.append(first[owner] + nth * step[owner] - b[owner])
            lengths.append(np.full(len(owner), length))
    return np.concatenate(blocks), np.concatenate(distances), np.concatenate(lengths)


def runs_of(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All runs of all texts, as rows (text, start, length, period) in that order.

    Text i has the codes from `starts[i]` to `starts[i + 1]`; codes are not negative.
    """
    texts = len(starts) - 1
    sizes = np.diff(starts)
    owners = np.repeat(np.arange(texts), sizes)
    kinds = int(codes.max()) + 2 if len(codes) else 1
    # Letters of a text are its own, and its end mark is unlike all others.
    letters = np.empty(len(codes) + texts, np.int64)
    moved = np.arange(len(codes)) + owners
    letters[moved] = owners * kinds + codes
    letters[starts[1:] + np.arange(texts)] = np.arange(texts) * kinds + kinds - 1
    found = factors(letters)
    block, period, length = candidates(found)
    start = block - reach_back(found.names, block, block + period)
    end = block + period + length
    end = end + reach(found.names, end - period, end)
    long = end - start >= np.maximum(LEAST, TIMES * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[least], end[least], period[least]
    text = letters[start] // kinds
    rows = np.column_stack((text, start - starts[text] - text, end - start, period))
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def kept_words(runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word, whether no run contains it after that run's first period."""
    change = np.zeros(starts[-1] + 1, np.int64)
    np.add.at(change, starts[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, starts[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(change)[:-1] == 0


def joined_words(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    counts = np.concatenate(([0], np.cumsum(kept)))[words.starts]
    spelled = words.spelled.take(pa.array(words.codes[kept]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spelled), " ")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def periodic_runs(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", collapse: bool = False
) -> DataFrame:
    """Runs of every text: at least `LEAST` words and `TIMES` periods long, as long as its
    smallest period holds, words split at ASCII white space.

    Returns the id column and `runs`, an array of (start, length, period) in words by start,
    then period, and with `collapse` also `collapsed`: the words that no run contains after
    its first period, joined by one space. A row for each row of `docs`, in any order;
    rows with equal or null ids are kept as they are, other columns are not read,
    whatever their names. Null, empty and blank texts have no runs and collapse to the
    empty text; equal words count as equal by their bytes, so case matters. A text of any
    length is searched whole in one task, in O(n log n) time and some 8 bytes a word for
    each doubling up to its longest repeat.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = split_words(part.column(1))
            found = runs_of(words.codes, words.starts)
            parts = [pa.array(found[:, i]) for i in (1, 2, 3)]
            counts = np.bincount(found[:, 0], minlength=part.num_rows)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            rows = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(span)))
            columns = {"id": part.column(0), "runs": rows}
            if collapse:
                columns["collapsed"] = joined_words(words, kept_words(found, words.starts))
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    schema = f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>"
    return map_batches(rows, run, schema + ", collapsed string" * collapse).withColumnRenamed("id", id_column)
