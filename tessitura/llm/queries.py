"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from tessitura.llm import decontamination, digest_index, jaccard_join, line_dedup, merkle, mixing, quality_rules, sharding, suffix_dedup, tool_calls, url_filters, warc, whitening


def queries() -> dict:
    return {
        "op1_mixing": mixing.query,
        "op2_warc": warc.query,
        "op3_url_filters": url_filters.query,
        "op4_tool_calls": tool_calls.query,
        "op5_decontamination": decontamination.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_sharding": sharding.query,
        "op8_line_dedup": line_dedup.query,
        "op9_jaccard_join": jaccard_join.query,
        "op10_quality_rules": quality_rules.query,
        "op11_merkle": merkle.query,
        "op12_whitening": whitening.query,
        "op13_exact_dedup": digest_index.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.oracle(),
        "op3_url_filters": url_filters.oracle(),
        "op4_tool_calls": tool_calls.oracle(),
        "op7_sharding": sharding.oracle(),
        "op8_line_dedup": line_dedup.oracle(),
        "op10_quality_rules": quality_rules.oracle(),
        "op11_merkle": merkle.oracle(),
        "op13_exact_dedup": digest_index.oracle(),
    }
