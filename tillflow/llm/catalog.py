"""The registered queries of this package and the SQL of those that SQL can express."""
from tillflow.llm import (chat, decontamination, fill_middle, fingerprints, language, lexical, lm_scoring, mixing, nearest, ngram_join, personal_data, sharding,
                          token_counts)

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_shards": sharding.op4_shards,
    "op5_language": language.op5_language,
    "op7_decontamination": decontamination.op7_decontamination,
    "op6_token_counts": token_counts.op6_token_counts,
    "op8_mixture": mixing.op8_mixture,
    "op9_personal_data": personal_data.op9_personal_data,
    "op10_chat": chat.op10_chat,
    "op11_lexical": lexical.op11_lexical,
    "op12_nearest": nearest.op12_nearest,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLES: dict[str, str] = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op11_lexical": lexical.ORACLE,
    "op12_nearest": nearest.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
