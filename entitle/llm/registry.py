"""Queries of the subpackage and their SQL twins."""

from __future__ import annotations

from entitle.llm import (
    conversation_repair, decontamination, exact_dedup, html_extraction, language_id, mixing, near_dedup, pieces, quality_rules,
    secret_scan, substring_dedup, suffix_dedup, whitening,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_language_id": language_id.op2,
    "op3_mix_sources": mixing.op3,
    "op4_pieces": pieces.op4,
    "op5_secret_scan": secret_scan.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_near_dedup": near_dedup.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_main_text": html_extraction.op9,
    "op10_suffix_dedup": suffix_dedup.op10,
    "op11_conversation_repair": conversation_repair.op11,
    "op12_decontamination": decontamination.op12,
    "op13_whitening": whitening.op13,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_near_dedup": near_dedup.OP7_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op10_suffix_dedup": suffix_dedup.OP10_SQL,
    "op11_conversation_repair": conversation_repair.OP11_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
}
