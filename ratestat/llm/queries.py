"""The operators' registered queries and, where SQL can express them, their
SQL."""

from __future__ import annotations

from ratestat.llm import (conversation_repair, decontam, language, lexical_search, lm_scores, near_dedup, packing,
                          quality, rule_cascade, simhash_tree, substring_dedup, token_counts, toxicity)

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_packing": packing.op2_packing,
    "op3_rule_cascade": rule_cascade.op3_rule_cascade,
    "op4_language": language.op4_language,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_lm_scores": lm_scores.op6_lm_scores,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_simhash_dedup": simhash_tree.op11_simhash_dedup,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

SQL = {
    "op3_rule_cascade": rule_cascade.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op7_near_dedup": near_dedup.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
