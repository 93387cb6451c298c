"""Dropped lines against all lines compared by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rideledger.llm import line_dedup as ld


def words(line):
    return tuple(x for x in re.split(r"[\x20\x09-\x0D]+", line) if x)


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(docs):
    """Documents in order of their ids: the text that stays."""
    seen, out = [], {}
    for doc_id, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        kept = []
        for line in (text or "").split("\n"):
            w = words(line)
            if not w or not any(near(w, s) for s in seen):
                kept.append(line)
            if w:
                seen.append(w)
        out[doc_id] = "\n".join(kept) if text is not None else None
    return out


def corpus(seed):
    rnd = random.Random(seed)
    lines, docs = [], []
    for d in range(60):
        mine = []
        for _ in range(rnd.randint(0, 6)):
            if lines and rnd.random() < 0.6:
                line = list(rnd.choice(lines))
                for _ in range(rnd.choice([0, 1, 1, 2])):
                    at = rnd.randrange(len(line) + 1)
                    line[at : at + rnd.randint(0, 1)] = [rnd.choice("abcdefg")] * rnd.randint(0, 1)
            else:
                line = [rnd.choice("abcdefgh") for _ in range(rnd.choice([0, 1, 4, 5, 6, 8, 9, 16, 17, 33]))]
            lines.append(line)
            mine.append((" " if rnd.random() < 0.8 else "\t ").join(line))
        docs.append((d, "\n".join(mine)))
    return docs


def test_equals_brute_force(spark):
    docs = corpus(3) + [(100, None), (101, ""), (102, "\n\n"), (103, "z " * 3000), (104, "q q q q q q\n" * 30)]
    for k in range(40):  # one variant key with many lines
        docs.append((200 + k, f"all of these lines share number {k} in one place"))
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, n string, w long")
    got = {r.doc_id: r.text for r in ld.dedup(df).collect()}
    assert got == brute(docs)
    assert ld.dedup(df).columns == [*df.columns, "n_lines", "n_equal", "n_near"]


def test_defined_cases(spark):
    docs = [(None, "one line of plain text"), (None, "one line of plain text"), (1, "one line of plain text"), (1, "one line of plain text"), (2, "other"), (2, "another")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in ld.dedup(df).collect()), key=repr)
    assert got == sorted([(None, ""), (None, ""), *docs[2:]], key=repr)
    assert ld.dedup(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in ld.stage(df).collect()) == [1, 1, 2, 2]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near_any(a, b, bounds=ld.BOUNDS):
    """Bounds that grow with the line; a character in lines under so many words."""
    n, chars = min(len(a), len(b)), (" ".join(a), " ".join(b))
    if a == b:
        return True
    if n < bounds.min_words:
        return min(map(len, chars)) >= bounds.min_chars and abs(len(chars[0]) - len(chars[1])) < 2 and distance(*chars) <= 1
    most = max(1, n // bounds.words_an_edit)
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


def edited(rnd, line, n, letters):
    line = list(line)
    for _ in range(n):
        at = rnd.randrange(len(line) + 1)
        line[at : at + rnd.randint(0, 1)] = [rnd.choice(letters)] * rnd.randint(0, 1)
    return line


@pytest.mark.parametrize("bounds", [ld.BOUNDS, ld.Bounds(min_words=3, min_chars=6, words_an_edit=10), ld.Bounds(words_an_edit=10_000)])
def test_growing_bound(spark, bounds):
    rnd = random.Random(5)
    few, many = ["a", "bad"], [f"w{i}{end}" for i, end in enumerate("deoixt" * 50)]
    lines = []
    for n in (2, 3, 4, 5, 6, 19, 20, 21, 38, 39, 40, 41, 59, 60, 61, 83, 120, 200):
        for words_ in (few, many):
            for _ in range(3):
                base = [rnd.choice(words_) for _ in range(n)]
                lines += [base] + [edited(rnd, base, e, words_) for e in (1, 2, 2, 3, 4, n // 20, n // 20 + 1, n // 10)]
    passage = [f"p{i}" for i in range(30)]  # in many lines that have nothing else in common
    lines += [passage + [rnd.choice(many) for _ in range(20)] for _ in range(40)]
    for base in ("All rights reserved", "Read more here now", "Subscribe today", "terms", "impressions", "Click the red link"):
        lines += [list(filter(None, "".join(edited(rnd, base, e, "xyz ")).split(" "))) for e in (0, 1, 1, 1, 2)]
    rnd.shuffle(lines)
    lines = [x for x in lines if x]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.n_equal + r.n_near for r in ld.dedup(df, bounds).collect()}
    want = {i: int(any(near_any(tuple(x), tuple(y), bounds) for y in lines[:i])) for i, x in enumerate(lines)}
    assert got == want and 50 < sum(want.values()) < len(lines) - 50


def test_clashing_names(spark):
    names = ["n_lines", "n_near", "flags", "f_place", "h1", "key", "w", "place", "first", "line", "a.b", "__row", "doc_id", "text"]
    rows = [(*range(12), i, text) for i, text in enumerate(["one line of plain text", "one line of plain text\nand something else", None])]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    assert [tuple(r) for r in ld.stage(df).orderBy("doc_id").collect()] == [rows[0], (*range(12), 1, "and something else"), rows[2]]
    out = ld.dedup(df)
    assert out.columns == [*[n for n in names if n not in ("n_lines", "n_near")], "n_lines", "n_equal", "n_near"] and out.count() == 3


def test_two_words_and_one_letter(spark):
    line = [f"word{i}" for i in range(60)]
    twice = [*line[:20], "other", *line[21:40], "another", *line[41:]]
    docs = [(1, " ".join(line)), (2, " ".join(twice)), (3, "All rights reserved"), (4, "All rigths reserved"), (5, "All right reserved")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.n_near for r in ld.dedup(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_repeated_segments(spark):
    """Lines that differ at their beginning and then repeat two words: each different segment is one key, whatever its places."""
    bounds, rnd = ld.Bounds(words_an_edit=6), random.Random(9)
    lines = []
    for i in range(48):
        base = [f"w{rnd.randrange(40)}{rnd.choice('dnsx')}" for _ in range(rnd.randrange(0, 26))] + ["is", "done."] * rnd.randrange(20, 34)
        lines += [base, edited(rnd, base, rnd.randrange(1, 16), ["is", "done.", "other", "word"])]
    rnd.shuffle(lines)
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.n_equal + r.n_near for r in ld.dedup(df, bounds).collect()}
    want = {i: int(any(near_any(tuple(x), tuple(y), bounds) for y in lines[:i])) for i, x in enumerate(lines)}
    assert got == want and 10 < sum(want.values()) < len(lines) - 10
    keys = ld._long_keys(F.col("text"), F.size(F.split("text", " ")), bounds)
    rows = df.select(F.size(keys).alias("places"), ld.let(keys, ld._spans).alias("spans")).collect()
    assert all(len({s.run for s in r.spans}) == len(r.spans) for r in rows)
    assert max(r.places for r in rows) > 15 and min(len(r.spans) for r in rows) < 4


def test_only_documents_that_lose_lines(spark):
    """Lines that stay make no rows, and what is left of a text is the same wherever its dropped lines stand."""
    again, near_again = "this line comes more than once", "this line comes more than twice"
    docs = [(1, f"{again}\n\none of its own"), (2, f"{again}\nsecond\n\n{again}"), (3, f"\n{near_again}\n\n {again}\nthird\n"), (4, f"{again}\n{again}"), (5, None), (6, ""), (7, "\n"), (None, "x\n" * 2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.dropped] for r in ld.judged(df).collect()}
    assert got == {
        2: [(0, "equal"), (3, "equal")], 3: [(1, "near"), (3, "equal")], 4: [(0, "equal"), (1, "equal")], None: [(i, "equal") for i in range(1, 2000)]
    }
    rows = {r.doc_id: (r.text, r.n_lines, r.n_equal, r.n_near) for r in ld.dedup(df).collect()}
    assert rows == {
        1: (docs[0][1], 2, 0, 0), 2: ("second\n", 3, 2, 0), 3: ("\n\nthird\n", 3, 1, 1), 4: ("", 2, 2, 0),
        5: (None, 0, 0, 0), 6: ("", 0, 0, 0), 7: ("\n", 0, 0, 0), None: ("x\n", 2000, 1999, 0),
    }


def test_equal_without_broadcasts(spark, monkeypatch):
    """Where too many lines or keys are shared to be sent to all tasks, shuffled joins give the same."""
    rnd = random.Random(11)
    passage = [f"p{i}{'nx'[i % 2]}" for i in range(30)]
    lines = [passage + [rnd.choice("abcdn") + str(i % 7) for _ in range(25)] for i in range(30)]
    lines += [edited(rnd, x, 2, "abcd") for x in lines[:20]]
    df = spark.createDataFrame([*corpus(4), *[(100 + i, " ".join(x)) for i, x in enumerate(lines)]], "doc_id long, text string")
    rows = lambda: sorted(tuple(r) for r in ld.dedup(df).collect())
    sent = rows()
    monkeypatch.setattr(ld, "BROADCAST_LINES", 0)
    assert rows() == sent and sum(r[-1] for r in sent) > 20


def test_places_as_bits(spark):
    """The keys of a line are those that the greedy choice by places takes, or more where places share a bit."""
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        places = rnd.sample(range(rnd.choice([12, 64, 140])), 11)
        rows.append((i, 5, [j << ld.PLACE_BITS | p for j, p in enumerate(places)]))
    rows += [(200, 1, [0, 1 << ld.PLACE_BITS | 1, 2 << ld.PLACE_BITS | 2]), (201, 1, [64, 1 << ld.PLACE_BITS | 63, 2 << ld.PLACE_BITS | 65, 3 << ld.PLACE_BITS | 70])]
    df = spark.createDataFrame(rows, "i int, bound int, x array<bigint>")
    got = {r.i: list(r.y) for r in df.select("i", ld.let(F.col("x"), lambda x: ld._apart_segments(x, F.col("bound"))).alias("y")).collect()}
    for i, bound, keys in rows:
        seen, most = [], len(keys)
        for j, x in enumerate(keys):
            p = x & ld._PLACE
            if all(abs(p - q) > 1 for q in seen):
                seen.append(p)
            if len(seen) > bound:
                most = j + 1
                break
        assert got[i] == keys[: len(got[i])] and len(got[i]) >= most
        assert max(x & ld._PLACE for x in keys) > 62 or len(got[i]) == most
    assert len(got[201]) == 4


def test_long_keys_are_made_once(spark, monkeypatch):
    """Also for lines with other blanks than single spaces, and for documents that come twice."""
    made, keys = [], ld._long_keys
    monkeypatch.setattr(ld, "_long_keys", lambda *args: made.append(1) or keys(*args))
    line = [f"word{i}{'nx'[i % 2]}" for i in range(60)]
    near_ = [*line[:20], "other", *line[21:40], "another", *line[41:]]
    docs = [(1, " ".join(line) + "\nof few words"), (2, "\t ".join(near_) + "\nof its own"), (2, "\t ".join(near_) + "\nof its own"), (3, "  " + "\x0b".join(line) + " \r")]
    got = sorted((r.doc_id, r.n_lines, r.n_equal, r.n_near) for r in ld.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(1, 2, 0, 0), (2, 2, 0, 1), (2, 2, 0, 1), (3, 1, 1, 0)]
    assert len(made) == 1
