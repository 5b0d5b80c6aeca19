"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import embedding_dedup, exact_dedup, jaccard_join, language_id, line_dedup, packing, quality, sentencepiece_codec, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_language_id": language_id.op3_language_id,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_quality": quality.op6_quality,
        "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": line_dedup.OP4_SQL,
        "op5_substring_dedup": substring_dedup.OP5_SQL,
        "op7_embedding_dedup": embedding_dedup.OP7_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op10_jaccard_join": jaccard_join.OP10_SQL,
    }
