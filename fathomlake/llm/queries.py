"""The registered corpus queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, jaccard, licences, packing, quality, runs, sharding, substrings, suffix, tokens, toxicity, trie

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_license_scans": licences.op2_license_scans,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_sharding": sharding.op4_sharding,
    "op5_suffix_array_dedup": suffix.op5_suffix_array_dedup,
    "op6_benchmark_decontamination": decontamination.op6_benchmark_decontamination,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_chat_formatting": chat.op11_chat_formatting,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_prefix_trie": trie.op13_prefix_trie,
}
ORACLE = {**jaccard.ORACLE, **decontamination.ORACLE, **substrings.ORACLE, **chat.ORACLE, **trie.ORACLE}
