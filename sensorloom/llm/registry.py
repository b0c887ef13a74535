"""The queries of this subpackage."""

from __future__ import annotations

from sensorloom.llm import decontamination, html_text, license_scan, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sentence_pieces, token_alignment, token_counts, toxicity, vector_codes

_MODULES = (decontamination, line_dedup, quality_classifier, toxicity, token_counts, packing, quality_rules, near_dedup, html_text, license_scan, token_alignment, vector_codes, sentence_pieces)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
