"""Queries of this package and their oracle SQL."""

from __future__ import annotations

from heddle.llm import ann, exact_topk, mixing, packing, pages, pii, sharding, simhash, token_files, toxicity

QUERIES = {
    "op1_nearest_neighbours": ann.op1_nearest_neighbours,
    "op2_exact_topk": exact_topk.op2_exact_topk,
    "op3_pii": pii.op3_pii,
    "op4_page_text": pages.op4_page_text,
    "op5_stratified_shards": sharding.op5_stratified_shards,
    "op6_simhash_components": simhash.op6_simhash_components,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_token_files": token_files.op8_token_files,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {"op4_page_text": pages.OP4_SQL, "op2_exact_topk": exact_topk.OP2_SQL, "op5_stratified_shards": sharding.OP5_SQL, "op9_mix_sources": mixing.OP9_SQL}
