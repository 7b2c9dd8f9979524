"""Queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from . import exact_dedup, near_dedup, packing, passage_dedup, quality_rules, suffix_dedup, token_store, unigram, weak_labels, word_lm

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_repeated_passages": passage_dedup.op2_repeated_passages,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_pitman_yor": word_lm.op4_pitman_yor,
    "op5_near_duplicates": near_dedup.op5_near_duplicates,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_token_files": token_store.op7_token_files,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quality_classifier": weak_labels.op9_quality_classifier,
    "op10_unigram": unigram.op10_unigram,
}

ORACLE = {
    "op3_quality_rules": quality_rules.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
}
