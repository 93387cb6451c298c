"""Edited texts exactly, likenesses against the true generalised Jaccard similarity."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rideledger.llm import fingerprints as fp


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    top = sum(max(a[x], b[x]) for x in a | b)
    return sum(min(a[x], b[x]) for x in a | b) / top if top else 1.0


def test_rows(spark, tmp_path):
    rnd = random.Random(4)
    texts = ["", " ", None, "one", "word " * 4000] + [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") + rnd.choice("aeiou") for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    ids = rnd.sample(range(-(10**12), 10**12), 30) + list(range(len(texts) - 30))
    rows = list(zip(ids, texts, strict=True))
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, signature long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fp.query(spark, str(tmp_path)).collect()}
    order, text = sorted(ids, reverse=True), {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    for i, d in enumerate(order):
        own, after = text[d], text[order[(i + 1) % len(order)]]
        third = len(own) // 3
        want = own[: len(own) - third] + after[:third]
        assert got[d].n_chars == len(own) and got[d].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        if min(len(own), len(want), len(after)) > 300:
            assert abs(got[d].near_edited - jaccard(own, want)) < 0.25
            assert abs(got[d].near_next - jaccard(own, after)) < 0.25


def test_likeness_has_no_bias(spark):
    rnd = random.Random(9)
    pairs = []
    for _ in range(300):
        a = [rnd.randrange(3000) for _ in range(500)] + [rnd.randrange(20) for _ in range(200)]
        b = [rnd.randrange(3000) if rnd.random() < 0.3 else x for x in a]
        pairs.append((" ".join(map(str, a)), " ".join(map(str, b))))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", fp.likeness(fp.signature(F.col("a")), fp.signature(F.col("b"))).alias("x")).collect()
    off = [r.x - jaccard(r.a, r.b) for r in got]
    assert abs(sum(off) / len(off)) < 0.02
    assert (sum(x * x for x in off) / len(off)) ** 0.5 < 0.07


@pytest.mark.parametrize("rows", [[], [(None, None)], [(5, "a b")], [(None, "x"), (None, "x"), (None, "y"), (7, "z"), (7, "z")]])
def test_defined_cases(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = fp.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.n_chars, r.edited_sha256), set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in by.values())


def test_one_far_id(spark):
    """Ranges stay small where one id, and then another, is far from the rest, and where ids are equal."""
    ids = [*range(20_000), 2**60, 2**40, -(2**62), *([2**50] * 6_000)]
    docs = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    slim = docs.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    ranged, levels = fp._id_ranges(slim)
    assert levels > 1 and ranged.groupBy("range").count().agg(F.max("count")).first()[0] <= 4 * fp.RANGE_ROWS
    got = {r.text: r.next_text for r in fp.with_next(docs).collect()}
    tie = {r.text: r.tie for r in slim.collect()}
    order = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda r: (-r[0], tie[r[1]]))
    assert got == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
