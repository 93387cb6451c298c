"""The pipeline's stages one by one against what they promise."""

import corpus_pipeline
from rideledger.llm import ngram_join
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import corpus


def test_near_duplicates(spark):
    rows = corpus(5) + [(1_000, None), (1_001, ""), (0, corpus(5)[0][1])]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    components = {r.doc_id: r.component_id for r in ngram_join.join(docs, 5, 80).collect()}
    got = ngram_join.stage(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, c in components.items() if d == c)


def test_whole_pipeline(spark, tmp_path):
    prose = "The committee met on Tuesday to discuss the new budget, and after a long debate it agreed to spend more on"
    rows = [(i, f"{prose} schools number {i} {i * 7} {i * i} in district {i % 9}, roads and public libraries\nA shared last line for every one of them", "en", f"s{i % 4}") for i in range(40)]
    rows += [(100, "short", "en", "s0"), (101, None, None, None), (102, rows[3][1], "en", "s1"), (103, "z q " * 60, "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {*range(40), 102}
    lines = corpus_pipeline.dedup_lines(spark, kept, str(tmp_path))
    want = brute_lines([(r[0], r[1]) for r in rows if r[0] < 40])
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    mixed = corpus_pipeline.mix_sources(spark, lines, str(tmp_path))
    assert mixed.columns == docs.columns
    size = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(size(mixed) - size(lines)) <= 4
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= set(range(40))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
