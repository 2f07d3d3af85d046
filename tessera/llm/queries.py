"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, cotraining, extraction, language, licenses, mixing, neighbours, periodic, pieces, quality_rules, simhash, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_simhash": simhash.op3_simhash,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_extraction": extraction.op5_extraction,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_language_id": language.op7_language_id,
    "op8_licenses": licenses.op8_licenses,
    "op9_cotraining": cotraining.op9_cotraining,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_chat_formatting": chat.op12_chat_formatting,
}

SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op12_chat_formatting": chat.OP12_SQL,
}
