"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from . import decontaminate, hamming, language_id, line_dedup, mixing, pii, quality, simhash, token_counts, toxicity

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_pii": pii.query,
    "op3_mixing": mixing.query,
    "op4_language_id": language_id.query,
    "op5_exact_topk": hamming.query,
    "op6_quality": quality.query,
    "op7_decontamination": decontaminate.query,
    "op8_line_dedup": line_dedup.query,
    "op9_simhash": simhash.query,
    "op10_toxicity": toxicity.query,
}
ORACLE_SQL = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op5_exact_topk": hamming.ORACLE_SQL,
    "op7_decontamination": decontaminate.ORACLE_SQL,
}
