"""Queries over whole tables, one for each operator, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from attestry.llm import alignment, bpe, exactdedup, hnsw, impacts, langid, licenses, packing, ppm, simhash, suffixdedup, threshold, toxicity

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_language_id": langid.op2_language_id,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_hnsw_neighbours": hnsw.op7_hnsw_neighbours,
    "op8_suffix_dedup": suffixdedup.op8_suffix_dedup,
    "op9_exact_dedup": exactdedup.op9_exact_dedup,
    "op10_ppm_scoring": ppm.op10_ppm_scoring,
    "op11_impact_search": impacts.op11_impact_search,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_threshold_topk": threshold.op13_threshold_topk,
}

ORACLES = {
    "op4_license_scan": licenses.oracle_sql(),
    "op9_exact_dedup": exactdedup.OP9_SQL,
    "op11_impact_search": impacts.OP11_SQL,
    "op13_threshold_topk": threshold.OP13_SQL,
}
