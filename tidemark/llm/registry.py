"""Queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import fingerprints, jaccard_join, licence_scan, line_dedup, line_rules, mixing, packing, quality_model, substring_dedup, url_filter
from tidemark.llm.oracles import ORACLE_SQL

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_licence_scan": licence_scan.op2_licence_scan,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_packing": packing.op4_packing,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_quality_rules": line_rules.op7_quality_rules,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_quality_model": quality_model.op9_quality_model,
    "op10_mixing": mixing.op10_mixing,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
