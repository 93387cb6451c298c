"""Components against all pairs compared by brute force."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rideledger.llm import ngram_join as nj
from rideledger.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or {tuple(words)}


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * x >= 90 * (len(sets[i]) + len(sets[j]) - x):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return sorted(((d, len(sets[i]), best.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "É", "A", "a"]
    rows = []
    while len(rows) < n:
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 3, 9, 12, 13, 30, 60, 200]))]
        rows.append(words)
        for _ in range(rnd.randint(0, 4)):
            copy = list(rnd.choice(rows[-5:]))
            for _ in range(rnd.randint(0, max(1, len(copy) // 30))):
                at = rnd.randrange(len(copy) + 1)
                copy[at : at + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] * rnd.randint(0, 1)
            rows.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(rows[:n])]


def test_equals_brute_force(spark):
    rows = corpus(1) + [(900, None), (901, " \n"), (None, "one two three four"), (None, "ONE two three\tfour"), (3, "one two three four"), (902, "x " * 5000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node long, n long")
    got = nj.join(docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert nj.join(docs.limit(0)).count() == 0


def test_tiles_lose_no_link(spark):
    rows = corpus(2, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, classes = nj.link_classes(docs, tile=7)
    _, whole = nj.link_classes(docs)
    assert sorted(map(repr, classes.collect())) == sorted(map(repr, whole.collect()))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 900), st.integers(0, 10**6), st.sampled_from([80, 90]))
def test_blocks_lose_no_link(n, seed, percent):
    rnd = np.random.default_rng(seed)
    a = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
    gone = rnd.integers(0, len(a) * (100 - percent) // 90 + 2)
    b = np.unique(np.concatenate([rnd.permutation(a)[gone:], rnd.integers(0, 2**64, rnd.integers(0, gone + 1), dtype=np.uint64)]))
    x = len(np.intersect1d(a, b))
    if len(b) and 100 * x >= percent * (len(a) + len(b) - x) and not np.array_equal(a, b):
        assert len(np.intersect1d(nj.block_keys(a, percent), nj.block_keys(b, percent)))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (7, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
