"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from surfacelab.llm import bpe, chat, language, lattice, mixing, quality_classifier, quality_rules, repair, resampling, simhash, token_files, vector_join, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_chat": chat.op3_chat,
    "op4_simhash": simhash.op4_simhash,
    "op5_language": language.op5_language,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_vector_join": vector_join.op8_vector_join,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
    "op11_resampling": resampling.op11_resampling,
    "op12_lattice": lattice.op12_lattice,
    "op13_repair": repair.op13_repair,
}

ORACLE_SQL = {
    "op3_chat": chat.op3_sql(),
    "op7_quality_rules": quality_rules.op7_sql(),
    "op8_vector_join": vector_join.op8_sql(),
    "op9_warc": warc.op9_sql(),
    "op11_resampling": resampling.op11_sql(),
    "op13_repair": repair.op13_sql(),
}
