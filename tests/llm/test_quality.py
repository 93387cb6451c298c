"""The base counts against a slow version, and the verdict on plain cases."""

import random
import re

from rideledger.llm import bpe, quality


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_counts(spark):
    rnd = random.Random(5)
    texts = ["", " \n\n", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x\ny\nx\n x\n\n\n", "é# 漢字 *|<> z", None]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) + "\n" * rnd.randint(0, 3) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, __lang string")
    for r in quality.measure(docs, ["doc_id"]).collect():
        want = slow(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.kept and r.base_failed)


def test_verdict(spark):
    prose = "The committee met on Tuesday to discuss the new budget, and after a long debate it agreed to spend more on schools, roads and public libraries in every district."
    texts = {1: prose, 2: " ".join(f"{chr(0xE000 + i)}{chr(0xE900 + i)}" for i in range(60)), 3: " ".join(f"a{'b' * (i % 7)}" for i in range(5)), 4: "z q " * 40, 5: "Заседание комитета прошло во вторник, и после долгого спора решили потратить больше денег на школы, дороги и публичные библиотеки во всех районах нашего большого города."}
    docs = spark.createDataFrame([(i, t, "en" if i == 1 else None, "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.kept for r in quality.measure(docs, ["doc_id"]).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert quality.stage(docs).columns == docs.columns
    assert quality.stage(docs.limit(0)).count() == 0


def test_measures_equal_the_library(spark):
    """Tokens, bytes and entropy of whole texts by the library itself, and the verdicts by plain medians."""
    import math
    from collections import Counter

    import numpy as np
    import sentencepiece

    rnd = random.Random(8)
    stems = ["the", "ing", "tion", "and", "er", "wh", "re", "st", "ou", "ea"]
    word = lambda: "".join(rnd.choice(stems) for _ in range(rnd.randint(1, 3)))
    texts = [" ".join(word() for _ in range(rnd.randint(25, 300))) for _ in range(150)]
    texts += [" ".join(w + "$%#"[i % 3] * 3 for i, w in enumerate(t.split())) for t in texts[:12]] + ["ж漢🙂 " * 5 + " ".join(word() for _ in range(30))]
    texts += texts[:1] * 200 + ["", None]
    df = spark.createDataFrame([(i, t, "xx", 0, "b") for i, t in enumerate(texts)], "doc_id long, text string, lang string, entropy long, band string")
    got = {r.doc_id: r for r in quality.measure(df, ["doc_id", "entropy"]).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path(quality.VOCABULARY))
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", num_threads=1)
        n, chars = len(ids), sum(map(len, (t or "").split()))
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) if n else 0.0
        want.append((n, chars / n if n else 0.0, sum(map(library.is_byte, ids)) / n if n else 0.0, entropy))
        assert got[i].n_tokens == n and got[i].chars_per_token == want[i][1] and got[i].byte_share == want[i][2] and abs(got[i].entropy - entropy) < 1e-9
    fit = np.array(sorted({w for i, w in enumerate(want) if not got[i].base_failed}))
    assert len(fit) >= quality.LIMITS.texts
    for i, w in enumerate(want):
        if got[i].base_failed:
            assert not got[i].kept
            continue
        away = []
        for k in (1, 2, 3):
            middle = np.median(np.round(fit[:, k] * 1000)) / 1000
            width = 1.4826 * np.median(np.round(np.abs(fit[:, k] - middle) * np.sqrt(fit[:, 0]) * 1000)) / 1000
            away.append((w[k] - middle) * math.sqrt(w[0]) / max(0.2, width))
        assert got[i].chars_ok == (-4 <= away[0] <= 8) and got[i].entropy_ok == (away[2] >= -5)
    junk = [got[i] for i in range(150, 162) if not got[i].base_failed]
    assert len(junk) > 5 and sum(r.kept for r in junk) <= len(junk) / 2
    assert sum(got[i].kept for i in range(150)) >= 0.95 * sum(not got[i].base_failed for i in range(150))


def test_few_texts_and_names(spark):
    text = " ".join(f"word{i} and some more prose" for i in range(40))
    rows = [(1, text, 5, "x", "y"), (2, "short", 6, "x", "y"), (3, None, 7, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, entropy long, band string, `a.b` string")
    kept = quality.stage(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == rows[:1]
    assert quality.stage(df.limit(0)).count() == 0
