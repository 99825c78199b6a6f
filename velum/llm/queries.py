"""The operators' queries and their DuckDB SQL, by name."""

from __future__ import annotations

from velum.llm import op1_ann, op2_counts, op3_licenses, op4_bpe, op5_simhash, op6_rules, op7_html, op8_pii, op9_packing, op10_classifier

QUERIES = {
    "op1_ann_search": op1_ann.query,
    "op2_token_counts": op2_counts.query,
    "op3_license_scan": op3_licenses.query,
    "op4_bpe": op4_bpe.query,
    "op5_near_duplicates": op5_simhash.query,
    "op6_quality_rules": op6_rules.query,
    "op7_html_text": op7_html.query,
    "op8_pii": op8_pii.query,
    "op9_packing": op9_packing.query,
    "op10_quality_classifier": op10_classifier.query,
}
ORACLE = {"op3_license_scan": op3_licenses.oracle()}
