"""The subpackage's queries and their SQL, by name."""

from . import chat, decontaminate, dedup, langid, lm, packing, pii, quality, topk, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_simhash_near_dedup": dedup.query,
    "op3_mtree_top_k": topk.query,
    "op4_lm_scoring": lm.query,
    "op5_chat_formatting": chat.query,
    "op6_language_id": langid.query,
    "op7_toxicity": toxicity.query,
    "op8_pii_sanitisation": pii.query,
    "op9_packing": packing.query,
    "op10_quality": quality.query,
}

#: The others score, fit, group or tokenise beyond SQL; their tests hold them against brute-force versions.
ORACLE_SQL = {
    "op1_decontamination": decontaminate.ORACLE,
    "op3_mtree_top_k": topk.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
}
