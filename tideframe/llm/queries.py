"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tideframe.llm import byte_bpe, cotraining, exact_dedup, jaccard_join, language_id, mixing, periodic_runs, prefix_trie, quality_rules, surrogates, token_counts, url_filter, weighted_sampling

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_pii_surrogates": surrogates.op2_pii_surrogates,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_language_id": language_id.op4_language_id,
    "op5_url_link_graph": url_filter.op5_url_link_graph,
    "op6_cotraining_quality": cotraining.op6_cotraining_quality,
    "op7_ngram_jaccard": jaccard_join.op7_ngram_jaccard,
    "op8_quality_divergence": quality_rules.op8_quality_divergence,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_weighted_sampling": weighted_sampling.op13_weighted_sampling,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op7_ngram_jaccard": jaccard_join.OP7_SQL,
}
