"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from meterlake.llm import bpe, chat, filter_audit, fingerprints, hard_negatives, html_text, jaccard, langid, lattice, line_runs, mixing, secret_scan, substrings

QUERIES = {
    "op1_secret_scans": secret_scan.op1_secret_scans,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_language_id": langid.op8_language_id,
    "op9_mixing": mixing.op9_mixing,
    "op10_embedding_dedup": lattice.op10_embedding_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_line_dedup": line_runs.op13_line_dedup,
}

ORACLES = {
    "op1_secret_scans": secret_scan.OP1_SQL,
    "op2_chat_formatting": chat.OP2_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_line_dedup": line_runs.OP13_SQL,
}
