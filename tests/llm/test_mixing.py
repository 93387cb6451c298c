"""Targets against a slow water filling, and what the mix takes against the targets."""

import random

import pytest
from pyspark.sql import functions as F

from rideledger.llm import mixing


def slow_targets(sizes):
    """sizes by source in order, null last: targets by sharing the excess again and again."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, full = sum(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        target = [3 * s if i in full else left * w / weight for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        more = {i for i, t in enumerate(target) if t > 3 * sizes[i] + 1e-9}
        if not more:
            return target
        full |= more


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_cuts(spark, seed):
    rnd = random.Random(seed)
    names = [f"s{i}" for i in range(rnd.randint(1, 9))] + [None]
    scale = {n: rnd.choice([0, 1, 3, 40]) for n in names}
    rows = [(i if rnd.random() < 0.9 else rnd.choice([None, 1, 2]), " ".join("w" * rnd.randint(0, scale[n])), n) for i, n in enumerate(rnd.choices(names, k=150))]
    rows += [(999, None, names[0])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size long, key string")
    planned, _ = mixing.plan(docs)
    got = planned.collect()
    assert len(got) == len(rows)
    order = sorted({r[2] for r in rows} - {None}) + ([None] if any(r[2] is None for r in rows) else [])
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in order]
    want = dict(zip(order, slow_targets(sizes), strict=True))
    for n, size in zip(order, sizes, strict=True):
        own = [r for r in got if r.source == n]
        assert all(r.source_size == size and abs(r.target - want[n]) < 1e-6 * max(1, size) and 0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[n]) <= 4  # whole words, and rows of one id share a cut rounded down
    assert sorted(map(tuple, mixing.plan(docs.repartition(7))[0].collect()), key=repr) == sorted(map(tuple, got), key=repr)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    for n in order:
        assert sum(len(r.text.split()) for r in mixed.collect() if r.source == n) == sum(r.taken for r in got if r.source == n)


def test_cuts_are_exact(spark):
    """Many sources of one seed each: the mix has just the words that the plan takes, source by source."""
    rnd = random.Random(7)
    names = [f"s{i:03}" for i in range(300)]
    rows = [(i, "w " * rnd.randint(1, 700), rnd.choice(names)) for i in range(1500)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, source string, __key long, last int")
    taken = {r.source: r.n for r in mixing.plan(docs)[0].groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    words = F.size(F.split(F.trim("text"), " "))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(words).alias("n")).collect()} == {k: v for k, v in taken.items() if v}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(docs)[0].count() == 0 and mixing.mix(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.plan(blank)[0].collect()] == [0, 0] and mixing.mix(blank).count() == 0
