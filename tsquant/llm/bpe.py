"""BPE encoding and decoding by a walk over the trie of distinct words.

White space always ends a token of the tokenizers this module takes, so a text is
the sequence of its words, and equal words have equal tokens. A task gathers the
distinct words of a slice of texts, cuts them into the pieces that the tokenizer
merges separately, and visits the trie of the distinct pieces depth first: sorted
pieces visit it in that order, with the current path as a stack. Every node holds
the last token of the encoding of its prefix. The encoding of a prefix is the
encoding of the prefix without that last token, and the last token; so a node looks
only at the tokens that end at it and at the states on its path, and pieces that
share a prefix share its states.

Of the tokens that end at a prefix, one alone can follow the state before it: two
neighbouring tokens are compatible if merging their joint symbols by rank gives
back the two. That rule is applied literally and remembered for each pair.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tsquant.llm.arrow import TwoGenerations, held, map_batches, text_slices
from tsquant.llm.words import split_words, text_bytes

#: Bytes of text whose words are gathered and encoded together.
SLICE_CHARS = 8 << 20
#: Words, and pieces of words, that a Python worker remembers in each of two generations.
WORDS = 200_000
PIECES = 200_000
#: Pairs of tokens whose compatibility a Python worker remembers.
PAIRS = 200_000
#: Endings of prefixes whose tokens a Python worker remembers.
STEPS = 200_000

#: Characters of the property White_Space, at which words end.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

WORD = re.compile(f"[^{WHITE}]+")
#: Those of them beyond ASCII.
OTHER_WHITE = f"[{''.join(c for c in WHITE if c > '\x7f')}]"
#: Letters of which no normal form changes and that lower case keeps one by one.
LATIN = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
PLAIN = re.compile(f"[!-~{LATIN}]*")
#: The pre-tokenizer's pattern for words of those letters and printable ASCII.
PLAIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


class Encoder:
    """Ids of words under one vocabulary file.

    The file must hold byte-level BPE with an end-of-word suffix and a pre-tokenizer
    that drops white space; any other file is refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model = parts["model"]
        self.end = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not self.end or model.get("dropout"):
            raise ValueError(f"{path} is not a BPE vocabulary with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(left, right): at for at, (left, right) in enumerate(pairs)}
        # The library's own steps before merging; its model stays empty to save memory.
        parts["model"] = {"type": "BPE", "vocab": {}, "merges": []}
        self.library = Tokenizer.from_str(json.dumps(parts))
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.inner = {t for t in self.vocab if not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end) for t in self.vocab if t.endswith(self.end)}
        bodies = self.inner | self.final
        self.starts = {body[:at] for body in bodies for at in range(1, len(body) + 1)}
        # By the end that matters, of which there are no more than starts; by prefix ends met.
        self.ends: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {}
        self.steps: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        spell = self.library.pre_tokenizer.pre_tokenize_str
        self.letters = {ord(letter): spell(letter)[0][0] for letter in LATIN.lower()}
        self.words = TwoGenerations(self.encode_words, WORDS)
        self.parts = TwoGenerations(self.encode_pieces, PIECES)

    @cached_property
    def tokens(self) -> pa.Array:
        return pa.array(vocabulary(self.path))

    def merged(self, symbols: list[str]) -> list[str]:
        """Merging by rank, the pair of lowest rank first, from the left."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == len(self.rank):
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end):
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return [*token]

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            joint = self.symbols(left) + self.symbols(right) if left else self.symbols(right)
            known = self.merged(joint) == ([left, right] if left else [right])
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def step(self, ending: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
        """What the walk needs to know of a prefix that ends so.

        The longest end that starts some token, which is all that later steps depend
        on, and the tokens that end here, longest first: within a piece, and at its end.
        """
        while ending not in self.starts:
            ending = ending[1:]
        found = self.ends.get(ending)
        if found is None:
            tails = [ending[at:] for at in range(len(ending))]
            inner = tuple(t for t in tails if t in self.inner)
            found = self.ends[ending] = ending, inner, tuple(t + self.end for t in tails if t in self.final)
        return found

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of pieces, by a walk depth first over their trie.

        last[i] is the last token of the encoding of the path's first i characters,
        ends[i] the end of that prefix as `step` gives it.
        """
        out = {}
        last: list[str] = [""]
        ends: list[str] = [""]
        path = ""
        vocab, suffix = self.vocab, len(self.end)
        steps, pairs, compatible = self.steps, self.pairs, self.compatible
        for piece in sorted(pieces):
            size = len(piece)
            limit = size - 1
            shared, most = 0, min(len(path), limit)
            while shared < most and path[shared] == piece[shared]:
                shared += 1
            del last[shared + 1 :], ends[shared + 1 :]
            for at in range(shared, size):
                ending = ends[at] + piece[at]
                known = steps.get(ending)
                if known is None:
                    if len(steps) >= STEPS:
                        steps.clear()
                    known = steps[ending] = self.step(ending)
                for token in known[1 if at < limit else 2]:
                    before = last[at + 1 - (len(token) if at < limit else len(token) - suffix)]
                    fits = pairs.get((before, token))
                    if fits or fits is None and compatible(before, token):
                        break
                else:
                    raise ValueError(f"the vocabulary has no token for the end of {piece!r}")
                if at < limit:
                    last.append(token)
                    ends.append(known[0])
            path = piece[:limit]
            ids, left = [vocab[token]], size - (len(token) - suffix)
            while left:
                token = last[left]
                ids.append(vocab[token])
                left -= len(token)
            ids.reverse()
            out[piece] = tuple(ids)
        return [out[piece] for piece in pieces]

    def pieces(self, word: str) -> list[str | int]:
        """Pieces of a word as the pre-tokenizer gives them; a special string is its id."""
        if PLAIN.fullmatch(word) and not ("<" in word and self.cut and self.cut.search(word)):
            found = PLAIN_PIECE.findall(word.lower())
            return found if word.isascii() else [piece.translate(self.letters) for piece in found]
        out: list[str | int] = []
        for part in self.cut.split(word) if self.cut else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                out += [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def cut_words(self, words: list[str]) -> list[list[str | int]]:
        """`pieces` of many words; words of plain letters are cut in one go."""
        plain = [word for word in words if PLAIN.fullmatch(word) and not ("<" in word and self.cut and self.cut.search(word))]
        found = PLAIN_PIECE.findall("\n".join(plain).lower())
        cut: dict[str, list[str | int]] = {}
        at = 0
        for word in plain:
            pieces, left = [], len(word)
            while left:
                piece = found[at]
                pieces.append(piece)
                left -= len(piece)
                at += 1
            cut[word] = pieces if word.isascii() else [piece.translate(self.letters) for piece in pieces]
        return [cut[word] if word in cut else self.pieces(word) for word in words]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each packed as little-endian 32-bit integers."""
        cut = self.cut_words(words)
        known = self.parts.of([p for pieces in cut for p in pieces if isinstance(p, str)])
        return [
            np.fromiter(chain.from_iterable(known[p] if isinstance(p, str) else (p,) for p in pieces), "<i4").tobytes()
            for pieces in cut
        ]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and where each text's start (and the last ends)."""
        words = split_words(pc.replace_substring_regex(pc.fill_null(texts, ""), OTHER_WHITE, " "))
        distinct = words.spelled.to_pylist()
        known = self.words.of(distinct)
        packed = [known[word] for word in distinct]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids, first = np.frombuffer(b"".join(packed), "<i4"), np.cumsum(sizes) - sizes
        each = sizes[words.codes]
        ends = np.concatenate(([0], np.cumsum(each)))
        at = np.arange(ends[-1]) + np.repeat(first[words.codes] - ends[:-1], each)
        return ids[at], ends[words.starts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, starts = self.encode_texts(pa.array(texts, pa.string()))
        return [part.tolist() for part in np.split(ids, starts[1:-1])] if texts else []


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by the Python worker."""
    return held(("bpe", path), lambda: Encoder(path))


def vocabulary(path: str) -> list[str]:
    """Tokens by id, added ones included."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    if parts["decoder"] is not None:
        raise ValueError(f"{path} has a decoder; only vocabularies without one are taken")
    tokens = {i: token for token, i in parts["model"]["vocab"].items()}
    tokens |= {t["id"]: t["content"] for t in parts["added_tokens"]}
    return [tokens.get(i, "") for i in range(max(tokens) + 1)]


def digests(data: bytes | memoryview, starts: np.ndarray, width: int = 1) -> list[str]:
    """SHA-256 of each stretch between neighbouring starts, in units of `width` bytes."""
    held = memoryview(data)
    return [hashlib.sha256(held[a:b]).hexdigest() for a, b in pairwise((starts * width).tolist())]


def ids_digests(ids: np.ndarray, starts: np.ndarray) -> list[str]:
    """Of ids as little-endian unsigned 32-bit integers."""
    return digests(np.ascontiguousarray(ids, "<u4").tobytes(), starts, 4)


def decode_ids(ids: np.ndarray, starts: np.ndarray, tokens: pa.Array) -> pa.Array:
    """The texts that ids stand for: their tokens, word ends included, joined by one space."""
    foreign = (ids < 0) | (ids >= len(tokens))
    if foreign.any():
        starts = starts - np.concatenate(([0], np.cumsum(foreign)))[starts]
        ids = ids[~foreign]
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), tokens.take(pa.array(ids)))
    return pc.binary_join(lists, " ")


def encode(
    docs: DataFrame,
    path: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    ids: bool = True,
    digested: bool = False,
) -> DataFrame:
    """Ids of every text, as the tokenizers library gives them without added special tokens.

    Returns the id column and, with `ids`, `ids` (array of int); with `digested` also
    `n_tokens`, `ids_sha256` (of the ids as little-endian unsigned 32-bit integers) and
    `decoded_sha256` (of the text that `decode` makes of the ids, in UTF-8), for which
    neither ids nor text leave the task. A row for each row of `docs`, in any order;
    other columns of `docs` are not read. A null text counts as empty and has no ids.
    Rows with equal or null ids are kept as they are. `path` must name a file that every
    executor can open.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        tokens = own.tokens if digested else None
        for part in text_slices(batches, chars=SLICE_CHARS):
            found, starts = own.encode_texts(part.column(1))
            columns = {"id": part.column(0)}
            if ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found))
            if digested:
                columns["n_tokens"] = pa.array(np.diff(starts), pa.int64())
                columns["ids_sha256"] = pa.array(ids_digests(found, starts))
                columns["decoded_sha256"] = pa.array(digests(*text_bytes(decode_ids(found, starts, tokens))))
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    schema = f"id {kind}" + ", ids array<int>" * ids
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" * digested
    return map_batches(rows, run, schema).withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, ids_column: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that the library decodes from an array of ids, special tokens included.

    A vocabulary without a decoder joins its tokens with one space, word ends
    included. A null array decodes as an empty one, to the empty text; an id outside
    the vocabulary, or a null one, decodes to nothing, as in the library. `out` must not
    be a column of `encoded`; the other columns are handed through.
    """
    if out in encoded.columns:
        raise ValueError(f"column {out} exists")
    fields = [*encoded.columns]
    at = fields.index(ids_column)
    schema = encoded.schema.add(out, "string")
    names = [f"c{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = held(("vocabulary", path), lambda: pa.array(vocabulary(path)))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(at)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
                flat = pc.fill_null(pc.list_flatten(lists), -1).to_numpy()
                texts = decode_ids(flat, np.concatenate(([0], np.cumsum(sizes))), tokens)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*names, "out"])

    plain = encoded.toDF(*names)
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema.fields))
    return map_batches(plain, run, f"{kinds}, out string").toDF(*fields, out)
