"""Tree concatenation against the library itself."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rideledger.llm import bpe

PATH = bpe.vocabulary_path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, run_chars=7, window=2)


ALPHABET = st.sampled_from(["a", "b", "the", "'s", "'", " ", "\n", "é", "é", "1", "23", "!!", "😀", "<|endoftext|>", "<|", " ", "A", "ll", "tion", "Σ"])


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, max_size=60).map("".join), st.integers(1, 12))
def test_tree_equals_library(text, piece):
    e = bpe.Encoder.__new__(bpe.Encoder)
    e.__dict__.update(_shared().__dict__)
    want = e.library.encode(text, add_special_tokens=False).ids
    assert e.tree(text, 0, len(text), piece)[:, 0].tolist() == want
    cut = [text[i : i + piece] for i in range(0, len(text), piece)]
    assert e.join_pieces(cut, [e.triples(x) for x in cut])[:, 0].tolist() == want


_MADE = []


def _shared():
    if not _MADE:
        _MADE.append(bpe.Encoder(PATH, run_chars=7, window=2))
    return _MADE[0]


def test_words_and_decode(encoder):
    text = "The  Cat's\t<|endoftext|>x <|startoftext|> aaaaaaaaaaaaaaaaaaaaaaaaaaaaaab c   12"
    split, ids = encoder.words([text.encode()])
    got = b"".join(ids[w] for w in split[0])
    want = encoder.library.encode(text, add_special_tokens=False).ids
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == want
    assert encoder.decode(got).decode() == encoder.library.decode(want, skip_special_tokens=False)


def test_query_equals_library(spark):
    texts = [None, "", " \n", "one two", "one two", "x" * 300, "Ab, " * 200, "é" * 50, "\x00 \x1f \x85z", None]
    rows = [(None if i == 1 else i, t, "clash", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    got = sorted(map(tuple, bpe.digests(docs, piece_chars=40).collect()), key=repr)
    library = _shared().library

    def row(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        plain = library.decode(ids, skip_special_tokens=False)
        return doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()

    assert got == sorted((row(r[0], r[1]) for r in rows), key=repr)
    assert bpe.digests(docs.limit(0)).count() == 0


def test_kept_columns_may_have_any_names(spark):
    names = ["__text", "__row", "__AT", "__piece", "__triples", "__row_"]
    docs = spark.createDataFrame([("a b " * 30, *range(6)), (None, *range(6))], "text string, " + ", ".join(f"`{n}` int" for n in names))
    out = bpe.encode(docs, names, piece_chars=50)
    assert out.columns == [*names, "ids", "decoded"]
    assert [tuple(r[n] for n in names) for r in out.collect()] == [tuple(range(6))] * 2
    assert {len(r.ids) for r in out.collect()} == {0, 240}


def test_many_texts_decode_at_once():
    """As the library's decode, texts without ids included."""
    e = _shared()
    texts = ["the 23 élan!!", "", "a", "😀 <|endoftext|> it's", " \n"]
    ids = [e.library.encode(t, add_special_tokens=False).ids for t in texts]
    packed = [b"".join(i.to_bytes(4, "little") for i in x) for x in ids]
    assert e.decode_all(packed).to_pylist() == [e.library.decode(x, skip_special_tokens=False) for x in ids]
    assert e.decode_all([]).to_pylist() == [] and e.decode_all([b""]).to_pylist() == [""]
