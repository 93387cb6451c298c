"""The manifest's digests against a plain recomputation, for several arities and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rideledger.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    i, text, lang, source, n = row
    return h(*map(field, (i, source, lang, n, text)))


def tree(digests, arity):
    """(root, path of each leaf): a path is a list of (before, after)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // arity * arity
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + arity])))
            at[k] = i // arity
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def brute(rows, arity):
    nulls_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    sources = sorted({r[3] for r in rows}, key=nulls_first)
    trees = [(of := sorted((r for r in rows if r[3] == s), key=lambda r: (nulls_first(r[0]), leaf(r))), *tree([leaf(r) for r in of], arity)) for s in sources]
    root, above = tree([t[1] for t in trees], arity)
    out = []
    for (of, sub, paths), up in zip(trees, above, strict=True):
        for r, path in zip(of, paths, strict=True):
            steps = path + up
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            acc = leaf((r[0], r[1].replace("\n", ""), *r[2:])) if bad else leaf(r)
            for left, right in steps:
                acc = h(left, acc, right)
            out.append((r[0], leaf(r), sub, root, h(*[x for s in steps for x in s]), acc, acc == root))
    return sorted(out, key=str)


ROWS = [(i, f"text {i}\nof é {'x' * i}", "en" if i % 3 else None, ["a", "b", "ä", None, ""][i % 5 if i > 20 else 0], i) for i in range(60)]
ODD = [(None, None, None, None, None), (None, "", "", "", 0), (7, ROWS[7][1], *ROWS[7][2:]), (7, "another 7", "en", "a", 9), (8, None, "en", "a", 1), (9, "long\n" * 50_000, "en", "zz", 1)]


def result(spark, rows, tmp_path, arity=3, more=()):
    folder = f"{tmp_path}/t{arity}"
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in more}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, merkle.query(spark, folder).collect()), key=str)


def test_query_is_brute_force(spark, tmp_path):
    got = result(spark, ROWS + ODD, tmp_path, more=("idx", "n", "tree", "left", "path", "__at", "digest"))
    assert got == brute(ROWS + ODD, 3)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("arity", [2, 5])
def test_other_arities(spark, arity):
    docs = spark.createDataFrame(ROWS + ODD, SCHEMA)
    out = merkle.manifest(docs, arity=arity)
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.fold(F.col("leaf"), F.col("path")))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((*r[:5], r[3]) for r in brute(ROWS + ODD, arity)), key=str)


def test_empty_and_single(spark, tmp_path):
    assert result(spark, [], tmp_path, 1) == []
    one = result(spark, ROWS[1:2], tmp_path, 2)[0]
    assert one[1] == one[2] == one[3] and one[4] == h("")


def test_change_of_any_column_shows(spark):
    docs = spark.createDataFrame(ROWS[4:7], SCHEMA).coalesce(1)
    root = merkle.manifest(docs).first().root
    for change in ({"lang": F.lit("xx")}, {"n_chars": F.lit(None).cast("long")}, {"source": F.upper("source")}):
        changed = docs.withColumns({c: F.when(F.col("doc_id") == 5, v).otherwise(F.col(c)) for c, v in change.items()})
        assert merkle.manifest(changed).first().root != root
