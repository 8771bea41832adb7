"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from moraine.llm import decontamination, embedding_dedup, line_dedup, mixing, pii, quality, secrets, simhash, substring_dedup, token_counts

QUERIES = {
    "op1_embedding_near_dedup": embedding_dedup.query,
    "op2_benchmark_decontamination": decontamination.query,
    "op3_pii_surrogates": pii.query,
    "op4_token_counts": token_counts.query,
    "op5_mix_sources": mixing.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_line_dedup": line_dedup.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_quality_classifier": quality.query,
    "op10_secret_scan": secrets.query,
}

ORACLES = {
    "op1_embedding_near_dedup": embedding_dedup.SQL,
    "op5_mix_sources": mixing.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op10_secret_scan": secrets.SQL,
}
