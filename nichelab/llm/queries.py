"""The queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from nichelab.llm import brown, conversations, decontaminate, exact, fim, jaccard, langid, license, mixing, quality, secrets, substring, urls

REGISTRY = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_exact_dedup": exact.op3_exact_dedup,
    "op4_quality": quality.op4_quality,
    "op5_license_scan": license.op5_license_scan,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_language_id": langid.op8_language_id,
    "op9_mixing": mixing.op9_mixing,
    "op10_url_filter": urls.op10_url_filter,
    "op11_lm_scoring": brown.op11_lm_scoring,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

#: Only queries that SQL can express over whole tables.
ORACLES = {
    "op1_decontamination": decontaminate.ORACLE,
    "op2_substring_dedup": substring.ORACLE,
    "op3_exact_dedup": exact.ORACLE,
    "op7_jaccard_join": jaccard.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op12_conversation_repair": conversations.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
