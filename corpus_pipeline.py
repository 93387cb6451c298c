"""A training-data pipeline over documents: quality rules, line dedup, near-duplicate join, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, with n_chars kept true to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rideledger.llm import bpe, line_dedup, mixing, ngram_join, quality
from rideledger.llm.common import stored, table


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the text as it is now, where they have that column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the tokeniser's bands reject go."""
    return quality.stage(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to earlier ones go, and documents of which nothing is left."""
    return _measured(line_dedup.stage(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by shingles of five words and a similarity of 0.8 or more, the first stays."""
    return ngram_join.stage(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at each source's budget one is cut after its last word within."""
    return _measured(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids, n_tokens and digests of every document of the mix."""
    out = bpe.encode(docs, ["doc_id", "source", "lang"])
    return out.select(
        "doc_id",
        "source",
        "lang",
        "ids",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the tokenisers; tests/llm/test_pipeline.py checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
