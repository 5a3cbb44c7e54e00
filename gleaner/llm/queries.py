"""The subpackage's registered queries, and the SQL that must give the same rows where SQL can express them."""

from __future__ import annotations

from gleaner.llm import conversations, exact_dedup, langid, licenses, mixing, packing, quality, secrets, simhash, spelling, substrings, tokens, topk

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_exact_top_k": topk.op3_exact_top_k,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_language_id": langid.op9_language_id,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_token_counts": tokens.op12_token_counts,
    "op13_conversation_trie": conversations.op13_conversation_trie,
}

ORACLES = {
    "op3_exact_top_k": topk.ORACLE_OP3,
    "op6_exact_dedup": exact_dedup.ORACLE_OP6,
    "op7_source_mixing": mixing.ORACLE_OP7,
    "op13_conversation_trie": conversations.ORACLE_OP13,
}
