"""Queries of the text operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from rideledger.llm import bpe, chat, fingerprints, langid, line_dedup, merkle, mixing, ngram_join, packing, phrases, quality, token_counts, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_line_dedup": line_dedup.query,
    "op3_token_counts": token_counts.query,
    "op4_ngram_jaccard": ngram_join.query,
    "op5_chat": chat.query,
    "op6_quality": quality.query,
    "op7_language": langid.query,
    "op8_mixing": mixing.query,
    "op9_fingerprints": fingerprints.query,
    "op10_bpe": bpe.query,
    "op11_packing": packing.query,
    "op12_phrases": phrases.query,
    "op13_merkle": merkle.query,
}
ORACLES = {"op5_chat": chat.ORACLE, "op8_mixing": mixing.ORACLE, "op12_phrases": phrases.ORACLE, "op13_merkle": merkle.ORACLE}
