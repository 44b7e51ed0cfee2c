"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from kernelfield.llm import jaccard_join, language_id, packing, quality_rules, secret_scan, source_mixing, suffix_dedup, token_counts, topk_search, warc

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_source_mixing": source_mixing.op2_source_mixing,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_warc": warc.op4_warc,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_packing": packing.op6_packing,
    "op7_language_id": language_id.op7_language_id,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLES = {"op1_suffix_dedup": suffix_dedup.ORACLE, "op4_warc": warc.ORACLE, "op5_jaccard_join": jaccard_join.ORACLE, "op9_topk_search": topk_search.ORACLE, "op10_quality_rules": quality_rules.ORACLE}
