"""Held-out accuracy and defined cases of the two models."""

import random

import pytest
from pyspark.sql import functions as F

from rideledger.llm import langid, toxicity

STEMS = {"en": ["the", "ing", "tion", "and", "er", "wh"], "de": ["ung", "sch", "ich", "ver", "keit", "ä"], "xx": ["за", "ро", "ва", "ни", "ст", "ла"]}
INSULTS = ["zblorgfink", "qwimpy", "dratvokel"]


def texts(n, seed):
    rnd = random.Random(seed)
    for i in range(n):
        lang = rnd.choice(list(STEMS))
        words = ["".join(rnd.choice(STEMS[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(15, 60))]
        toxic = rnd.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        yield i, " ".join(words), lang, int(toxic)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(texts(500, 3)), "doc_id long, text string, lang string, toxic int").withColumn("score", F.lit("x")).cache()


def test_languages(spark, docs):
    got = langid.predict(docs.drop("score"), ["doc_id", "lang"], langid.train(docs))
    held = got.filter(langid.held_out(F.col("doc_id")))
    assert held.filter("lang <> lang_pred").count() <= 1
    assert got.filter("score < 0 or score > 1").count() == 0


def test_toxic(spark, docs):
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = toxicity.score(docs.drop("score"), ["doc_id", "toxic"], model)
    held = got.filter(toxicity.held_out(F.col("doc_id"))).select(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).alias("ok"))
    assert held.filter("not ok").count() <= 2
    plain = "thetion anding whing theand ering tioner "
    s = model.scores([plain, plain + "zblorgfink thewh zblorgfink", plain + "z.b.l.o.r.g.f.i.n.k thewh zblorgfiink", ""])
    assert s[0] < 0.5 < s[1] and s[2] > 3 * s[0] and s[3] < 0.5


def test_single_disguised_insult():
    rows = list(texts(500, 3))
    model = toxicity.fit([r[1] for r in rows], [r[3] for r in rows])
    clean = [r[1] for r in texts(400, 9) if not r[3]]
    assert sum(model.scores(clean) >= 0.5) <= 2
    for word in INSULTS:
        half = len(word) // 2
        ways = [word, ".".join(word), " ".join(word), "..".join(word), "-.-".join(word), f"{word[:half]}*{word[half:]}", f"{word[:half]}x{word[half:]}", f"{word[:half]}{word[half]}{word[half:]}"]
        for way in ways:
            assert sum(model.scores([f"{text} {way} thewh" for text in clean[:40]]) >= 0.5) >= 38, way


def test_many_languages(spark):
    """None of 300 languages is left out, and a long text gives what it gives as one piece."""
    rows = [(7 * i + k, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} word {k} {chr(0x4E00 + i)}", f"l{i}") for i in range(300) for k in range(5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 300
    right = [a == r[2] for a, r in zip(model.predict([r[1] for r in rows])[0], rows, strict=True)]
    assert sum(right) > 0.95 * len(rows)
    small = langid.fit([r[1] for r in texts(60, 5)], [r[2] for r in texts(60, 5)])
    long = " ".join(r[1] for r in texts(3000, 6))
    whole, n = small.logits([long])
    langid.PIECE_CHARS, limit = 1_000, langid.PIECE_CHARS
    try:
        assert len(langid.in_pieces([long, "a"], limit=1_000)[0]) > 100
        cut, m = small.logits([long])
    finally:
        langid.PIECE_CHARS = limit
    assert (n == m).all() and abs(whole - cut).max() < 1e-3


def test_document_frequencies(spark):
    rows = [r[1] for r in texts(50, 5)]
    want = sum((langid.counts(t) > 0).astype(int) for t in rows)
    got = langid.document_frequencies(spark.createDataFrame([(t,) for t in rows], "text string").repartition(3))
    assert (got == want).all()


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (None, "12 34 !"), (4, "word " * 20_000), (4, "word")]
    df = spark.createDataFrame([(*r, None, 1) for r in rows], "doc_id long, text string, lang string, one int")
    assert langid.train(df) is None
    assert {r.lang_pred for r in langid.predict(df, ["doc_id"], None).collect()} == {"und"}
    labels = df.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    assert toxicity.train(df, labels) is None
    assert toxicity.score(df, ["doc_id"], None).count() == 5
    model = langid.fit(["some text here", "ein anderer text"], ["en", "de"])
    got = langid.predict(df, ["doc_id", "one"], model).collect()
    assert [r.lang_pred for r in got if r.score == 0] == ["und"] * 3 and len(got) == 5
    only = toxicity.fit(["a b", "c d"], [0, 0])
    assert toxicity.score(df, ["doc_id"], only).filter("score between 0 and 0.5").count() == 5
    assert toxicity.score(df.limit(0), ["doc_id"], only).count() == 0


@pytest.mark.parametrize("fitted", [True, False])
def test_kept_columns_may_have_any_names(spark, docs, fitted):
    odd = docs.select("doc_id", "text", "lang", F.lit(1).alias("__text"), F.lit(2).alias("__TEXT_"))
    model = langid.train(docs) if fitted else None
    for out in (langid.predict(odd, ["__text", "__TEXT_"], model), toxicity.score(odd, ["__text", "__TEXT_"], None)):
        assert {(r["__text"], r["__TEXT_"]) for r in out.collect()} == {(1, 2)}
