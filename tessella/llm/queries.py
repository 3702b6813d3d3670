"""Queries over the driver's tables, one for each operator, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_store, op02_language, op03_lines, op04_pieces, op05_packing, op06_counts, op07_quality, op08_exact, op09_urls, op10_minhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op01_store.query,
        "op2_language_id": op02_language.query,
        "op3_line_dedup": op03_lines.query,
        "op4_sentencepiece": op04_pieces.query,
        "op5_best_fit_packing": op05_packing.query,
        "op6_token_counts": op06_counts.query,
        "op7_quality_rules": op07_quality.query,
        "op8_exact_dedup": op08_exact.query,
        "op9_url_filters": op09_urls.query,
        "op10_minhash_dedup": op10_minhash.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": op07_quality.SQL, "op8_exact_dedup": op08_exact.SQL, "op9_url_filters": op09_urls.SQL}
