"""Queries of this subpackage, by name, with SQL where SQL can express them."""

from __future__ import annotations

from foliant.llm import chat, exact_dedup, fingerprints, language, licences, line_dedup, mixing, near_dedup, pieces, quality

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_license_scan": licences.op2_license_scan,
    "op3_language_id": language.op3_language_id,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_fingerprints": fingerprints.op10_fingerprints,
}
SQL = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op7_chat_formatting": chat.OP7_SQL}
