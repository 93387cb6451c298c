"""Totals against a recount by the library, replays, and defined cases."""

import base64
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rideledger.llm import bpe, token_counts


def test_query_equals_recount(spark, tmp_path):
    rnd = random.Random(2)
    texts = ["", None, "One two!", "# a * b", "x" * 50] + [" ".join(rnd.choice(["the", "cat's", "sat#", "<b>", "12"]) for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    rows = [(i, rnd.choice(texts), rnd.choice(["a", "b", None]), rnd.choice(["en", None])) for i in range(120)]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, n_tokens long").write.parquet(f"{tmp_path}/documents.parquet")
    library = bpe.Encoder(bpe.vocabulary_path(bpe.VOCABULARY)).library
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    of_bytes = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    seen, docs, tokens = set(), Counter(), Counter()
    for _, text, source, lang in rows:
        if text is not None and text in seen or text is None and None in seen:
            continue
        seen.add(text)
        plain = re.sub(r"[#*$%&|<>]", "", text or "")
        for version, n in (("word_bpe_49k", len(library.encode(plain, add_special_tokens=False).ids)), ("byte_bpe_50k", len(of_bytes.encode_ordinary(plain)))):
            docs[source, lang, version] += 1
            tokens[source, lang, version] += n
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in token_counts.query(spark, str(tmp_path)).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}


def test_changes(spark, tmp_path):
    r = token_counts.Rollup(spark, str(tmp_path))
    batch = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, version string, source string, lang string, n_tokens long, seq long")
    totals = lambda: sorted((tuple(x) for x in r.totals().collect()), key=repr)
    assert totals() == []
    r.commit(0, batch((1, "v", "s", "en", 5, 0), (1, "v", "s", "en", 7, 1), (2, "v", "s", None, 1, 0), (None, "v", "s", "en", 3, 0), (None, "v", "s", "en", 3, 0)))
    assert totals() == [("s", "en", "v", 3, 13), ("s", None, "v", 1, 1)]
    moved = batch((1, "v", "t", "en", 9, 0), (2, "v", "s", None, None, 0), (77, "v", "s", "en", None, 0), (2, "w", "s", "en", 4, 0))
    for _ in range(2):
        r.commit(1, moved)
        assert totals() == [("s", "en", "v", 2, 6), ("s", "en", "w", 1, 4), ("t", "en", "v", 1, 9)]
    assert r.commit(2, batch()) and len(totals()) == 3
    before = totals()
    # A replay after a later batch says nothing new, even with other rows; a batch from before that nobody knows is an error.
    assert not r.commit(1, batch((5, "v", "s", "en", 5, 0))) and totals() == before
    with pytest.raises(ValueError):
        r.commit(-1, moved)
    # What a lost batch left doesn't count, and the batch is written anew over it.
    half = batch((9, "v", "s", "en", 50, 0)).withColumn("docs", F.lit(1).cast("bigint")).withColumnRenamed("n_tokens", "tokens").drop("seq")
    half.write.parquet(f"{r.ledger}/batch_id=3")
    half.drop("doc_id").write.parquet(f"{r.deltas}/batch_id=3")
    assert totals() == before
    assert r.commit(3, batch((9, "v", "s", "en", 1, 0))) and totals()[0] == ("s", "en", "v", 3, 7)
