"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import queries_corpus as corpus
from . import queries_text as text

QUERIES = {
    "op1_line_dedup": corpus.op1_line_dedup,
    "op2_bpe_round_trip": text.op2_bpe_round_trip,
    "op3_best_fit_packing": text.op3_best_fit_packing,
    "op4_pii": corpus.op4_pii,
    "op5_ngram_jaccard_join": corpus.op5_ngram_jaccard_join,
    "op6_suffix_dedup": corpus.op6_suffix_dedup,
    "op7_media_columns": text.op7_media_columns,
    "op8_language_id": text.op8_language_id,
    "op9_token_counts": text.op9_token_counts,
    "op10_quality_rules": text.op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": corpus.OP1_SQL,
    "op5_ngram_jaccard_join": corpus.OP5_SQL,
    "op6_suffix_dedup": corpus.OP6_SQL,
}
