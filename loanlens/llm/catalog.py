"""Query names of this subpackage, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from loanlens.llm import (bpe, chat, filter_audit, infill, line_dedup, lm, mixing, ngram_join, pii, quality_classifier, quality_rules,
                          sharding, winnow)

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_bpe": bpe.op3_bpe,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_personal_data": pii.op7_personal_data,
    "op8_sharding": sharding.op8_sharding,
    "op9_winnowing": winnow.op9_winnowing,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_chat_formatting": chat.op11_chat_formatting,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE = {
    "op2_mix_sources": mixing.ORACLE_OP2,
    "op4_quality_rules": quality_rules.ORACLE_OP4,
    "op6_ngram_join": ngram_join.ORACLE_OP6,
    "op11_chat_formatting": chat.ORACLE_OP11,
    "op12_fill_in_middle": infill.ORACLE_OP12,
    "op13_filter_audit": filter_audit.ORACLE_OP13,
}
