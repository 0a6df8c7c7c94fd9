"""Registered queries of the training-data operators and their oracle SQL."""

from trailmesh.llm import bpe, conversation_repair, decontaminate, exact_dedup, jaccard_join, lexical_search, licenses, lm_score, pii, quality, secrets, substring_dedup, toxicity

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_quality": quality.op3_quality,
    "op4_pii": pii.op4_pii,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_substring_dedup": substring_dedup.OP13_SQL,
}
