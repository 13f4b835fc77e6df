"""Registry of the training-data queries and their SQL twins."""

from __future__ import annotations

from varietas.llm import (chat, decontaminate, fingerprint, hard_negatives, jaccard_join, language,
                          linededup, packing, private_data, quality, sharding, spelling,
                          token_files)

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_fingerprints": fingerprint.op3_fingerprints,
    "op4_sharding": sharding.op4_sharding,
    "op5_packing": packing.op5_packing,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_language_id": language.op7_language_id,
    "op8_token_files": token_files.op8_token_files,
    "op9_chat_format": chat.op9_chat_format,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_personal_data": private_data.op12_personal_data,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE = {
    "op1_jaccard_join": jaccard_join.OP1_SQL,
    "op6_line_dedup": linededup.OP6_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op10_decontamination": decontaminate.OP10_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
}
