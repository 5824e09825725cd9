"""Words of many texts at once, as codes in numpy arrays.

A word is a maximal run of characters other than the six blanks of ASCII, which is how
Arrow splits at ASCII white space once the empty strings at the edges are left out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    """`codes` of the words of all texts in order; text i has those from `starts[i]` to
    `starts[i + 1]`. Equal words have equal codes, `spelled[code]` is the word."""

    codes: np.ndarray
    starts: np.ndarray
    spelled: pa.Array


class Parts(NamedTuple):
    """Non-empty parts of texts: `codes` in order, the text of each, their spellings."""

    codes: np.ndarray
    owners: np.ndarray
    spelled: pa.Array


def _parts(lists: pa.Array, trim=lambda parts: parts) -> Parts:
    flat = lists.flatten()
    owners = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    keep = pc.greater(pc.binary_length(trim(flat)), 0)
    mask = keep.to_numpy(zero_copy_only=False).astype(bool)
    coded = flat.filter(keep).dictionary_encode()
    return Parts(coded.indices.to_numpy().astype(np.int64), owners[mask], coded.dictionary)


def split_words(texts: pa.Array) -> Words:
    """Words of texts; null counts as empty."""
    found = _parts(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
    counts = np.bincount(found.owners, minlength=len(texts))
    return Words(found.codes, np.concatenate(([0], np.cumsum(counts))), found.spelled)


def split_lines(texts: pa.Array) -> Parts:
    """Lines, cut at \\n, that hold a word; null counts as empty."""
    return _parts(pc.split_pattern(pc.fill_null(texts, ""), "\n"), pc.ascii_trim_whitespace)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and where each starts (and the last ends)."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    first = int(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]) if len(texts) else 0
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8)[first : first + starts[-1]] if data else np.zeros(0, np.uint8)
    return held, starts


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values of each stretch between neighbouring starts."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[starts[1:]] - total[starts[:-1]]
