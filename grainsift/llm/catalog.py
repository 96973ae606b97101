"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from grainsift.llm import decontaminate, exact_dedup, language_id, mixing, near_dedup, quality, substring_dedup, token_counts, token_shards, url_filter


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_token_shards": token_shards.op3_token_shards,
        "op4_language_id": language_id.op4_language_id,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_quality": quality.op7_quality,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op10_url_filter": url_filter.OP10_SQL}
