"""Token counts; documents too long for one call are encoded in overlapping chunks.

For tokenizers that drop white space, a word between white space is encoded alike
wherever it stands, so the start of a word is a proven boundary. Texts up to
`chunk_chars` count the tokens of their words, each distinct word encoded once per
worker by the library. A longer text is cut into chunks of that size, each starting
`overlap_chars` before the end of the one before; every chunk is encoded with
offsets. Two neighbours are spliced at the first word start inside their overlap at
which both have a token and from which on both agree, token by token, up to the end
of a word at least. An overlap is placed where it holds a whole word: behind a word that
is longer than the overlap, so that such a word is encoded once. Where no place agrees
the overlap doubles, back to the start of the chunk before if need be, and then the two
chunks are encoded as one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tsquant.llm.arrow import TwoGenerations, held, map_batches, text_slices
from tsquant.llm.bpe import WHITE, WORD

#: Words a Python worker remembers in each of two generations.
WORDS = 300_000
#: A longer text is encoded in chunks of so many characters.
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512

WORD_START = re.compile(f"(?<=[{WHITE}])(?=[^{WHITE}])")
Token = tuple[int, int, int]


class Counter:
    """Counts tokens under one tokenizers file that drops white space."""

    def __init__(self, path: str):
        if not path.endswith(".json"):
            raise ValueError(f"{path}: only files of the tokenizers library are taken")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        probe = self.library.encode(" a  b\n", add_special_tokens=False)
        if probe.offsets != [(1, 2), (4, 5)]:
            raise ValueError(f"{path} keeps white space in its tokens: words are no boundaries there")
        self.words = TwoGenerations(self.of_words, WORDS)

    def of_words(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def chunk(self, text: str, start: int, end: int) -> list[Token]:
        """Tokens of text[start:end] as (start, end, id), places being those of the text."""
        found = self.library.encode(text[start:end], add_special_tokens=False)
        return [(start + a, start + b, i) for (a, b), i in zip(found.offsets, found.ids, strict=True)]

    def chunked(self, text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[Token]:
        """Tokens of a whole text, spliced from overlapping chunks."""
        if not 0 < overlap < size:
            raise ValueError("the overlap must be shorter than a chunk")
        done: list[Token] = []
        start = 0
        fresh, end = overlap_of(text, size, overlap)
        held = self.chunk(text, start, end)
        while end < len(text):
            following, stop = overlap_of(text, end + size - overlap, overlap)
            while True:
                tokens = self.chunk(text, fresh, stop)
                if fresh == start:  # the two chunks as one
                    held = tokens
                    break
                at = splice(text, held, tokens, fresh, end)
                if at is not None:
                    done += held[: at[0]]
                    held, start = tokens[at[1] :], text_start(tokens, at[1], stop)
                    break
                fresh = max(start, end - 2 * (end - fresh))
            fresh, end = following, stop
        return done + held

    def count(self, texts: list[str], size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
        words = [WORD.findall(text) if len(text) <= size else [] for text in texts]
        known = self.words.of([word for found in words for word in found])
        return [
            sum(map(known.__getitem__, found)) if len(text) <= size else len(self.chunked(text, size, overlap))
            for text, found in zip(texts, words, strict=True)
        ]


def overlap_of(text: str, end: int, overlap: int) -> tuple[int, int]:
    """Start and end of the overlap of two chunks that meet about `end`.

    It holds two word starts, so a whole word: where the last characters before `end`
    do not, it moves on behind the long word, which is encoded whole. The end is that
    of the text if there is no such place.
    """
    if end >= len(text):
        return len(text), len(text)
    first = end - overlap
    starts = WORD_START.finditer(text, first + 1)
    one, two = next(starts, None), next(starts, None)
    if two is None:
        return len(text), len(text)
    return (first, end) if two.start() < end else (max(first, one.start() - 1), two.start() + 1)


def text_start(tokens: list[Token], at: int, stop: int) -> int:
    return tokens[at][0] if at < len(tokens) else stop


def splice(text: str, left: list[Token], right: list[Token], start: int, end: int) -> tuple[int, int] | None:
    """Where two chunks that overlap in text[start:end] can be joined.

    Returns the number of tokens to keep of the left chunk and to drop of the right.
    """
    spaces = WORD_START.finditer(text, start + 1, end)
    starts = [m.start() for m in spaces]
    # Each but the last is followed by a whole word inside the overlap.
    tail = {}
    for at in range(len(left) - 1, -1, -1):
        if left[at][0] <= start:
            break
        tail[left[at][0]] = at
    head = {}
    for at, token in enumerate(right):
        if token[0] >= end:
            break
        head[token[0]] = at
    for this, following in zip(starts, starts[1:]):
        a, b = tail.get(this), head.get(this)
        c, d = tail.get(following), head.get(following)
        if None not in (a, b, c, d) and left[a:c] == right[b:d]:
            return a, b
    return None


def counter(path: str) -> Counter:
    """The counter of a file, kept by the Python worker."""
    return held(("counts", path), lambda: Counter(path))


def token_counts(
    docs: DataFrame,
    path: str,
    *,
    limit: int = 2048,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Adds up the tokens of every text, as the tokenizers library encodes it.

    Returns the id column, `n_bytes` (of the text in UTF-8), `n_tokens` (without
    added special tokens) and `over_limit` (more than `limit` tokens), a row for each
    row of `docs`; other columns of `docs` are not read. A null text counts as empty:
    0 bytes, 0 tokens. Rows with equal or null ids are kept as they are. `path` must
    name a file that every executor can open.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for part in text_slices(batches):
            texts = [text or "" for text in part.column(1).to_pylist()]
            counts = own.count(texts, chunk_chars, overlap_chars)
            size = pc.cast(pc.fill_null(pc.binary_length(part.column(1)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), size, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    schema = f"id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return map_batches(rows, run, schema).withColumnRenamed("id", id_column)
