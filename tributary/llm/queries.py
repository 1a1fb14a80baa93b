"""The driver's queries of this subpackage and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from . import decontaminate, fingerprints, hpy_lm, near_dup, secrets, sharding, tokens, toxicity, url_filter

QUERIES = {
    "op1_near_duplicates": near_dup.op1_near_duplicates,
    "op2_secrets": secrets.op2_secrets,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sharding": sharding.op4_sharding,
    "op5_sentencepiece": tokens.op5_sentencepiece,
    "op6_language_model": hpy_lm.op6_language_model,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_token_counts": tokens.op10_token_counts,
}

ORACLES: dict[str, str] = {"op1_near_duplicates": near_dup.ORACLE, "op7_decontamination": decontaminate.ORACLE}
