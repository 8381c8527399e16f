"""The queries of this package, and their SQL where it exists."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import chat, jaccard, language, lines, mixing, neighbours, packing, quality, runs, substrings, tokens, toxicity, whitening

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_mix_sources": mixing.op2,
    "op3_repeated_strings": substrings.op3,
    "op4_line_dedup": lines.op4,
    "op5_language_id": language.op5,
    "op6_chat_format": chat.op6,
    "op7_tree_neighbours": neighbours.op7,
    "op8_quality_rules": quality.op8,
    "op9_prefix_token_counts": tokens.op9,
    "op10_jaccard_join": jaccard.op10,
    "op11_periodic_runs": runs.op11,
    "op12_embedding_whitening": whitening.op12,
    "op13_toxicity": toxicity.op13,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op2_mix_sources": mixing.SQL, "op4_line_dedup": lines.SQL, "op6_chat_format": chat.SQL, "op8_quality_rules": quality.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
