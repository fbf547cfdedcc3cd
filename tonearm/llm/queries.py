"""The corpus operators' queries, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tonearm.llm import brown, chat, decontaminate, filters, fingerprints, html, mixing, quality, ranked, sharding, simhash, substrings, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_pages": html.op2_pages,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_chat": chat.op4_chat,
    "op5_substrings": substrings.op5_substrings,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_mixing": mixing.op7_mixing,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_brown": brown.op10_brown,
    "op11_sharding": sharding.op11_sharding,
    "op12_search": ranked.op12_search,
    "op13_filters": filters.op13_filters,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op4_chat": chat.OP4_SQL, "op12_search": ranked.OP12_SQL, "op13_filters": filters.OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
