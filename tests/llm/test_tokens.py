"""Token counts and BPE against the library itself."""

import hashlib
import struct
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.cases import ODD_TEXTS, documents, no_documents
from tokenizers import Tokenizer

from tsquant.llm.bpe import Encoder, decode, encode
from tsquant.llm.queries import QUERIES
from tsquant.llm.token_counts import Counter, splice, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)
COUNTER = Counter(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


pieces = st.lists(
    st.one_of(
        st.text(max_size=12),
        st.sampled_from(["don't", "we'll", "'s", "<|endoftext|>", "é", "é", "ﬁ", "İ", "12", "…", " ", "\n\t", "　"]),
        st.text("abcdefgh", min_size=1, max_size=20),
    ),
    max_size=12,
)


@settings(max_examples=150, deadline=None)
@given(pieces)
def test_encoding_is_the_librarys(parts):
    text = "".join(parts)
    assert ENCODER.encode([text])[0] == ids_of(text)


@settings(max_examples=60, deadline=None)
@given(pieces, st.integers(8, 40), st.integers(1, 7))
def test_chunks_are_spliced_to_the_whole(parts, size, overlap):
    text = " ".join(parts * 3)
    assert [t[2] for t in COUNTER.chunked(text, size, overlap)] == ids_of(text)


def test_every_space_of_the_library_ends_a_word():
    texts = [f"a{chr(c)}b" for c in range(0x3100)]
    assert ENCODER.encode(texts) == [ids_of(t) for t in texts]


def test_no_splice_without_a_whole_word_in_both():
    text = "aaaa" * 20
    left, right = COUNTER.chunk(text, 0, 40), COUNTER.chunk(text, 30, 80)
    assert splice(text, left, right, 30, 40) is None
    assert [t[2] for t in COUNTER.chunked(text, 40, 10)] == ids_of(text)


@pytest.mark.parametrize("text", ["x" * 4_000_000, ("ab1" * 9_000 + " ") * 80, "é" * 70_000 + " end"])
def test_texts_of_long_words_take_linear_time(text):
    """No more than five calls of the library on the whole text; the least of three tries counts."""

    def seconds(run):
        took = []
        for _ in range(3):
            started = time.process_time()
            run()
            took.append(time.process_time() - started)
        return min(took)

    own, library = [], []
    alone = seconds(lambda: library.append(ids_of(text)))
    mine = seconds(lambda: own.append([t[2] for t in COUNTER.chunked(text)]))
    assert own[0] == library[0]
    assert mine < 5 * alone + 0.05


def test_overlaps_move_behind_long_words():
    long = "word " * 10 + "x" * 500 + " one two " + "y" * 300 + " " + "end " * 30
    ids = ids_of(long)
    for size, overlap in ((40, 10), (64, 32), (100, 20), (700, 5)):
        assert [t[2] for t in COUNTER.chunked(long, size, overlap)] == ids


def test_forgotten_words_are_encoded_again():
    own = Encoder(PATH)
    own.words.half = 3
    texts = ["one two three four", "five six one", "two one seven", "three five"]
    assert [own.encode([t])[0] for t in texts * 2] == [ids_of(t) for t in texts * 2]


def test_counts_of_odd_rows(spark):
    rows = token_counts(documents(spark), PATH, limit=9, chunk_chars=64, overlap_chars=16).collect()
    expected = [(i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 9) for i, t in ODD_TEXTS]
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
    assert token_counts(no_documents(spark), PATH).collect() == []


def test_round_trip_of_odd_rows(spark):
    rows = decode(encode(documents(spark), PATH, digested=True), PATH).collect()
    assert len(rows) == len(ODD_TEXTS)
    found = sorted(((r.doc_id, r.ids, r.decoded, r.ids_sha256) for r in rows), key=repr)
    expected = []
    for i, text in ODD_TEXTS:
        ids = ids_of(text)
        sha = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        expected.append((i, ids, LIBRARY.decode(ids, skip_special_tokens=False), sha))
    assert found == sorted(expected, key=repr)
    assert decode(encode(no_documents(spark), PATH), PATH).collect() == []


def test_decode_takes_null_and_foreign_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, 10**6, -1, 49407])], "x long, ids array<int>")
    found = {r.x: r.decoded for r in decode(rows, PATH).collect()}
    assert found == {1: "", 2: "", 3: LIBRARY.decode([320, 49407], skip_special_tokens=False)}
    with pytest.raises(ValueError):
        decode(rows.withColumnRenamed("x", "decoded"), PATH)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        Counter(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        Counter(public_tokenizers.path("piece_bpe_32k.model"))


def test_queries_over_whole_tables(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    counts = {r.doc_id: r for r in QUERIES["op1_token_counts"](spark, FOLDER).collect()}
    coded = {r.doc_id: r for r in QUERIES["op2_bpe"](spark, FOLDER).collect()}
    assert counts.keys() == coded.keys() == texts.keys()
    for i, text in texts.items():
        ids = ids_of(text)
        assert counts[i][1:] == (len(text.encode()), len(ids), len(ids) > 2048)
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert coded[i].n_tokens == len(ids)
        assert coded[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
