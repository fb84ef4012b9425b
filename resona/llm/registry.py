"""Queries and oracle SQL of the subpackage."""

from __future__ import annotations

from . import hard_negatives, hyperminhash, language_id, lattice_lm, media, mixing, packing, runs, simhash, substrings, topk_search, toxicity, url_filter

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_topk_search": topk_search.op4_topk_search,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_simhash": simhash.op7_simhash,
    "op8_lattice_lm": lattice_lm.op8_lattice_lm,
    "op9_language_id": language_id.op9_language_id,
    "op10_media_webp": media.op10_media_webp,
    "op11_hyperminhash": hyperminhash.op11_hyperminhash,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
ORACLE = {
    "op1_mix_sources": mixing.SQL,
    "op4_topk_search": topk_search.SQL,
    "op6_url_filter": url_filter.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
