"""The registered queries of this subpackage."""

from __future__ import annotations

from . import ann, base_queries, hash_search, html_extract, jaccard_join, language_id, license_scan, lm_score, mixing, packing, pii

QUERIES = {
    f.__name__: f
    for f in (
        pii.op1_semi_markov_pii,
        language_id.op2_ppm_language_id,
        ann.op3_hilbert_neighbours,
        lm_score.op4_log_bilinear_scores,
        jaccard_join.op5_ngram_jaccard_join,
        html_extract.op6_crf_html_extraction,
        packing.op7_best_fit_packing,
        license_scan.op8_suffix_automaton_license_scan,
        hash_search.op9_multi_index_hashing,
        mixing.op10_entropy_balanced_mix,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard_join": jaccard_join.ORACLE,
    "op9_multi_index_hashing": hash_search.ORACLE,
}

# beside the ten: the parts of five of them that SQL can express
QUERIES |= base_queries.QUERIES
ORACLE_SQL |= base_queries.ORACLE_SQL
