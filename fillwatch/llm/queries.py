"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from fillwatch.llm import chat, decontam, embeddings, licenses, linededup, mixing, periods, quality, simhash, substrings, tokenfiles, toxicity, turns

QUERIES = {
    "op1_decontaminate": decontam.query,
    "op2_quality": quality.query,
    "op3_embedding_dedup": embeddings.query,
    "op4_substring_dedup": substrings.query,
    "op5_license_scan": licenses.query,
    "op6_simhash": simhash.query,
    "op7_toxicity": toxicity.query,
    "op8_chat_format": chat.query,
    "op9_line_dedup": linededup.query,
    "op10_mix": mixing.query,
    "op11_token_files": tokenfiles.query,
    "op12_turn_repair": turns.query,
    "op13_periodic_runs": periods.query,
}

ORACLES = {"op1_decontaminate": decontam.ORACLE, "op3_embedding_dedup": embeddings.ORACLE, "op5_license_scan": licenses.ORACLE, "op8_chat_format": chat.ORACLE, "op9_line_dedup": linededup.ORACLE, "op10_mix": mixing.ORACLE, "op12_turn_repair": turns.ORACLE, "op13_periodic_runs": periods.ORACLE}
