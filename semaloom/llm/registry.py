"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from semaloom.llm import html_extract, jaccard, mixing, neardup, packing, pii, quality, substring, topk, url_filter

QUERIES = {
    "op1_quality_gam": quality.op1_quality_gam,
    "op2_balltree_topk": topk.op2_balltree_topk,
    "op3_hnsw_near_dedup": neardup.op3_hnsw_near_dedup,
    "op4_fm_substring_dedup": substring.op4_fm_substring_dedup,
    "op5_bestfit_packing": packing.op5_bestfit_packing,
    "op6_pareto_mixing": mixing.op6_pareto_mixing,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_pii_boosting": pii.op8_pii_boosting,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_html_extraction": html_extract.op10_html_extraction,
}
ORACLE_SQL = {
    "op2_balltree_topk": topk.OP2_SQL,
    "op3_hnsw_near_dedup": neardup.OP3_SQL,
    "op4_fm_substring_dedup": substring.OP4_SQL,
    "op6_pareto_mixing": mixing.OP6_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
}
