"""Pieces against the tokenizers library, packings against their rules and the least number of sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rideledger.llm import packing
from rideledger.llm.bpe import vocabulary_path

SCHEMA = "doc_id bigint, text string, piece int, length string, idx int, n int"
TEXTS = [
    None, "", " ", "  two  spaces ", "\n\n x\ty   z　w", "it's we'll 'S\t\tX", "a<|endoftext|> b <|endoftext|>", "ünï çødé 漢字 かな", "\x1c x \x1c",
    " lead", "trail ", "tab\t x", "a \n b", "x" * 5000, "word " * 9000, "\n ".join(["line"] * 50), "1 22 333 4444", "dup dup", "dup dup", "é ​ z \x85 q",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY + ".json"))
    t.no_truncation()
    t.no_padding()
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def rows_of(seed=0, n=60):
    rnd = random.Random(seed)
    alphabet = ["the", "Of", " ", "  ", "\n", "x9", "'s", "…", " ", "ß", ",", "\t"]
    texts = TEXTS + ["".join(rnd.choice(alphabet) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 300))) for _ in range(n)]
    return [(None if i == 3 else i, t, 1, "x", 2, 3) for i, t in enumerate(texts)] + [(7, "again", 0, "", 0, 0)] * 3


@pytest.mark.parametrize("slice_chars", [40, 1_000_000])
def test_ids_are_the_librarys(library, slice_chars):
    for t in [t for _, t, *_ in rows_of(5, 300) if t]:
        parts = [packing.encoder(packing.VOCABULARY).encode(s) for s in packing.seams(t, slice_chars)]
        assert np.frombuffer(b"".join(parts), dtype="<u4").tolist() == library(t)[:-1]


def test_query_follows_the_contract(spark, library, tmp_path):
    rows = rows_of()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = packing.query(spark, str(tmp_path)).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = library(text)
        first = (len(ids) - 1) % 2048 + 1
        for p, a in enumerate([0, *range(first, len(ids), 2048)]):
            b = first if p == 0 else a + 2048
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    check_places([(r.sequence_id, r.offset, r.length) for r in out], 2048)
    assert len({r.sequence_id for r in out}) == -(-sum(r.length for r in out) // 2048)


def check_places(places, capacity):
    held = defaultdict(list)
    for s, offset, length in places:
        held[s].append((offset, length))
    for inside in held.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity


def fewest(counts, capacity):
    """The least number of sequences that any packing needs: by tokens, and by pieces over half of the capacity."""
    return max(-(-sum(x * c for x, c in counts.items()) // capacity), sum(c for x, c in counts.items() if 2 * x > capacity))


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 257, 2048])
    kind = rnd.choice(["small", "any", "large", "few"])
    most = {"small": max(1, capacity // 9), "any": capacity, "large": capacity, "few": capacity}[kind]
    least = capacity // 3 + 1 if kind == "large" else 1
    counts = Counter(rnd.randint(least, most) for _ in range(rnd.choice([1, 30, 3000])))
    if kind == "few":
        counts = Counter({x: rnd.randint(1, 10**9) for x in list(counts)[:5]})
    made = packing.plan(dict(counts), capacity)
    used = Counter()
    for lengths, times in made:
        assert sum(lengths) <= capacity and times > 0
        for x in lengths:
            used[x] += times
    assert used == counts
    if kind in ("small", "any") and sum(counts.values()) >= 3000:
        assert sum(t for _, t in made) <= fewest(counts, capacity) * 1.01 + 1


def test_stock_finds_exact_complements_only():
    rnd = random.Random(3)
    for _ in range(200):
        counts = Counter(rnd.randint(1, 20) for _ in range(rnd.randint(1, 6)))
        stock = packing._Stock(dict(counts), 40)
        stock.add(next(iter(counts)), -1)
        counts[next(iter(counts))] -= 1
        for gap in range(1, 41):
            got = stock.exact(gap)
            pool = list(counts.elements())
            possible = {sum(c) for k in (1, 2, 3) for c in __import__("itertools").combinations(pool, k)}
            assert bool(got) == (gap in possible)
            assert not got or (sum(got) == gap and not Counter(got) - counts)


def test_sequences_hold_the_ids(spark, library):
    docs = spark.createDataFrame(rows_of(1, 20), SCHEMA)
    found = packing.stored(packing.pieces(docs, ["doc_id", "n", "piece"], capacity=100, with_ids=True))
    assert found.columns == ["doc_id", "n", "piece", "start", "length", "ids_crc32", "ids"]
    packed = packing.pack(found, ["doc_id", "piece"], capacity=100)
    out = packing.sequences(packed)
    tokens = Counter()
    for i in (row[1] for row in rows_of(1, 20)):
        tokens.update(library(i))
    got = Counter()
    for r in out.collect():
        assert len(r.ids) == 4 * r.length <= 400
        got.update(np.frombuffer(r.ids, dtype="<u4").tolist())
    assert got == tokens


def test_kept_columns_may_have_any_names(spark):
    names = ["__at", "__part", "__idx", "__n", "idx", "n", "__shift"]
    docs = spark.createDataFrame([(f"text {i}", *range(7)) for i in range(9)], "text string, " + ", ".join(f"`{n}` int" for n in names))
    out = packing.pack(packing.stored(packing.pieces(docs, ["text", *names])), ["__at"])
    assert out.columns == ["text", *names, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [tuple(r[n] for n in names) for r in out.collect()] == [tuple(range(7))] * 9


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert packing.query(spark, str(tmp_path)).count() == 0
    assert packing.plan({}) == []
