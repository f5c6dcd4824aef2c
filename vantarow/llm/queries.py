"""Registry of the queries of this subpackage and their SQL."""

from __future__ import annotations

from vantarow.llm import chat_tree, decontaminate, licence, lm_score, merkle, ngram_join, packing, pii, quality, secrets, substring_dedup, url_filter, vector_codes

QUERIES = {
    "op1_licence_scan": licence.op1,
    "op2_ngram_join": ngram_join.op2,
    "op3_decontamination": decontaminate.op3,
    "op4_quality_rules": quality.op4,
    "op5_lm_scoring": lm_score.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_best_fit_packing": packing.op7,
    "op8_pii": pii.op8,
    "op9_url_filter": url_filter.op9,
    "op10_secret_scan": secrets.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_chat_format": chat_tree.op13,
}
ORACLE_SQL: dict[str, str] = {
    "op9_url_filter": url_filter.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_chat_format": chat_tree.ORACLE,
}
