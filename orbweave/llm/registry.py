"""Queries and oracles of the corpus operators."""

from __future__ import annotations

from orbweave.llm import exact_dedup, katz, minhash, mixing, ngram_jaccard, packing, resampling, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard.op1_ngram_jaccard,
    "op2_minhash_fingerprints": minhash.op2_minhash_fingerprints,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxicity_crf": toxicity.op4_toxicity_crf,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_pareto_mixing": mixing.op8_pareto_mixing,
    "op9_importance_resampling": resampling.op9_importance_resampling,
    "op10_katz_scores": katz.op10_katz_scores,
    "minhash_components": minhash.query_minhash_components,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op8_pareto_mixing": mixing.ORACLE,
}
