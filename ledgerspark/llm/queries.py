"""Queries of this subpackage, by name."""

from __future__ import annotations

from . import ann, decontam, langid, lm, mixing, neardup, orchard, quality, runs, substrings, tokenids, toxicity, urlfilter


def llm_queries() -> dict:
    """One query per operator over its whole table."""
    return {
        "op1_source_mixing": mixing.op1_source_mixing,
        "op2_minhash_near_dedup": neardup.op2_minhash_near_dedup,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op4_hnsw_nearest": ann.op4_hnsw_nearest,
        "op5_lm_scoring": lm.op5_lm_scoring,
        "op6_url_filter": urlfilter.op6_url_filter,
        "op7_language_id": langid.op7_language_id,
        "op8_quality_classifier": quality.op8_quality_classifier,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_decontaminate": decontam.op10_decontaminate,
        "op11_token_ids": tokenids.op11_token_ids,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_vector_codes": orchard.op13_vector_codes,
    }
