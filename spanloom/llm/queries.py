"""The registered queries of the training-data operators."""

from __future__ import annotations

from spanloom.llm import byte_bpe, chat_format, language_id, packing, permutation_index, quality_rules, secret_forest, sharding, simhash_dedup, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
    "op3_permutation_index": permutation_index.op3_permutation_index,
    "op4_packing": packing.op4_packing,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_sharding": sharding.op7_sharding,
    "op8_secret_forest": secret_forest.op8_secret_forest,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language_id": language_id.op10_language_id,
}
ORACLES = {
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op1_chat_format": chat_format.OP1_SQL,
}
