"""The ten operators' queries and their SQL."""

from __future__ import annotations

from sableframe.llm import chat_format, html_extract, line_dedup, mixing, near_duplicates, packing, quality_classifier, quality_rules, sketch, token_counts


def queries() -> dict:
    """Queries by name; each takes (spark, sf_dir)."""
    return {
        "op1_html_text": html_extract.op1_html_text,
        "op2_quality_outliers": quality_rules.op2_quality_outliers,
        "op3_length_histogram": token_counts.op3_length_histogram,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_jaccard_join": near_duplicates.op6_jaccard_join,
        "op7_quality_scores": quality_classifier.op7_quality_scores,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_pack": packing.op9_pack,
        "op10_fingerprints": sketch.op10_fingerprints,
    }


def oracle_sql() -> dict:
    """DuckDB SQL by the name of the query."""
    return {"op4_chat_format": chat_format.oracle(), "op8_mix_sources": mixing.oracle()}
