"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from scriptorium.llm import byte_bpe, chat_format, exact_dedup, hard_negatives, mixing, ngram_join, quality, sharding, suffix_dedup, token_counts, toxicity, url_filter, vector_codes


def queries() -> dict:
    found = (toxicity.op1_toxicity, ngram_join.op2_ngram_join, exact_dedup.op3_exact_dedup, sharding.op4_sharding, mixing.op5_mixing, chat_format.op6_chat_format, quality.op7_quality_rules, suffix_dedup.op8_suffix_dedup, url_filter.op9_url_filter, byte_bpe.op10_byte_bpe, hard_negatives.op11_hard_negatives, token_counts.op12_token_counts, vector_codes.op13_vector_codes)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.SQL, "op6_chat_format": chat_format.SQL, "op9_url_filter": url_filter.SQL, "op11_hard_negatives": hard_negatives.SQL, "op13_vector_codes": vector_codes.SQL}
