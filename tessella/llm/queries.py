"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, exact_dedup, language_id, lm_scoring, ngram_jaccard, packing, quality_rules, token_counts, toxicity, url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_language_id": language_id.op3_language_id,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_ngram_jaccard": ngram_jaccard.op7_ngram_jaccard,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES = {"op2_quality_rules": quality_rules.SQL, "op7_ngram_jaccard": ngram_jaccard.SQL, "op10_exact_dedup": exact_dedup.SQL}
