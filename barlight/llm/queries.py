"""The queries of this subpackage, by name, and their DuckDB SQL where there is one."""

from barlight.llm import alignment, chat, exact_dedup, importance, licenses, lm_scoring, mixing, near_dedup, pieces, quality, secrets, sharding, suffix_dedup

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_license_scans": licenses.op9_license_scans,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_cross_alignment": alignment.op11_cross_alignment,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_sharding": sharding.op13_sharding,
}
ORACLES = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op5_mixing": mixing.OP5_SQL, "op8_chat_formatting": chat.OP8_SQL, "op9_license_scans": licenses.OP9_SQL, "op12_importance_resampling": importance.OP12_SQL}
