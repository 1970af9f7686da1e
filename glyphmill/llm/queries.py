"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from . import decontamination, language_id, lm_scoring, mixing, near_dedup, pii, quality, spotsigs, tool_links, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_tool_links": tool_links.op2_tool_links,
    "op3_quality": quality.op3_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mix": mixing.op5_mix,
    "op6_decontaminate": decontamination.op6_decontaminate,
    "op7_fingerprints": spotsigs.op7_fingerprints,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_lm_scores": lm_scoring.op9_lm_scores,
    "op10_pii": pii.op10_pii,
}

SQL = {
    "op2_tool_links": tool_links.OP2_SQL,
    "op5_mix": mixing.OP5_SQL,
    "op6_decontaminate": decontamination.OP6_SQL,
}
