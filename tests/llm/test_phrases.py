"""Phrases against a plain count of everything, for windows of several sizes."""

import random
import re
from collections import Counter, defaultdict

import pytest

from rideledger.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, words string, next string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, longest=5, subsumed=100, top=2000):
    f = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for m in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        often = {p: c for p, c in count.items() if len(p) > 1 and c >= min_count}
        covered = {}
        for p, c in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(c, covered.get(p[i : i + m], 0))
        kept = []
        for p, a in often.items():
            if 100 * covered.get(p, 0) < subsumed * a:
                score, k = min((1000 * a * n // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]], n))
        for rank, (s, a, p, left, right, n) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["a", "B", "ñandú", "D-e", "f\x00g", " h", "the", "of", "Zz"]
    ends = [" ", "  ", "\t", " ", " ", " ", ", ", ".", "\n", "\r\n", "; "]
    fixed = "the quick B of a."
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(0, 60)))
        rows.append((i, text + (fixed if i % 3 else " ".join(["dup dup"] * 4)), rnd.choice(["en", "de", None, "und"]), "x", None))
    return rows + [(None, None, None, None, None), (None, "", "en", None, "y"), (1, " \n\t", "fr", "", ""), rows[0], rows[0], (9, "dup " * 3000, "en", "x", "x")]


def found(spark, rows, **args):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = phrases.best(phrases.phrases(docs, **args)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("window", [7, 500, 2_000_000])
def test_phrases_are_brute_force(spark, window):
    rows = corpus(window)
    assert found(spark, rows, min_count=6, window_words=window) == brute(rows, 6)


def test_full_filter_loses_nothing(spark):
    """A filter of 64 bits lets nearly everything pass; the result is the same."""
    rows = corpus(1)
    assert found(spark, rows, min_count=9, subsumed=60, longest=4, filter_bits=6) == brute(rows, 9, 4, 60)


def test_empty_tables_and_short_tops(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, "en", "", "")], min_count=1) == []
    rows = [(i, "p q r s. q r", "en", "", "") for i in range(5)]
    assert found(spark, rows, min_count=5) == brute(rows, 5)
    some = phrases.best(spark.createDataFrame([("en", str(i), i // 2, 1) for i in range(20)], "lang string, phrase string, score bigint, a bigint"), 3)
    assert [r.phrase for r in some.orderBy("rank").collect()] == ["18", "19", "16"]


@pytest.mark.parametrize("size", [1, 3, 10, 10_000])
def test_long_texts_are_split_in_runs(size):
    text = "Abc d.  efghijklmnop\tq\nrs, " * 4
    runs = list(phrases.tokens(text.encode(), size))
    whole = list(phrases.tokens(text.encode()))
    assert sum(runs, []) == sum(whole, []) and len(whole) == 1
    assert len(runs) > 1 or size == 10_000


def test_oracle_counts_the_same(spark, tmp_path):
    import duckdb

    rows = corpus(5)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = db.execute("SELECT lang, rank, phrase, a, l, r, n, score FROM (" + phrases.ORACLE.replace(f"f >= {phrases.MIN_COUNT}", "f >= 6") + ")").fetchall()
    assert sorted(got) == brute(rows, 6)
