"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pointloom.llm import op1_suffix_tree, op2_language_id, op3_token_store, op4_mixing, op5_near_duplicates, op6_separator_scan, op7_url_templates, op8_warc, op9_telephony_audio, op10_decontamination

QUERIES = {
    "op1_suffix_tree": op1_suffix_tree.query,
    "op2_language_id": op2_language_id.query,
    "op3_token_store": op3_token_store.query,
    "op4_mixing": op4_mixing.query,
    "op5_near_duplicates": op5_near_duplicates.query,
    "op6_separator_scan": op6_separator_scan.query,
    "op7_url_templates": op7_url_templates.query,
    "op8_warc": op8_warc.query,
    "op9_telephony_audio": op9_telephony_audio.query,
    "op10_decontamination": op10_decontamination.query,
}

ORACLES = {
    "op7_url_templates": op7_url_templates.ORACLE,
    "op8_warc": op8_warc.ORACLE,
    "op10_decontamination": op10_decontamination.ORACLE,
}
