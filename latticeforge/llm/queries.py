"""The queries of the corpus operators, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, embeddings, html, licenses, lines, mixing, pii, simhash, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_pii_surrogates": pii.query,
        "op2_html_extraction": html.query,
        "op3_license_scan": licenses.query,
        "op4_toxicity": toxicity.query,
        "op5_simhash_near_dedup": simhash.query,
        "op6_benchmark_decontamination": decontamination.query,
        "op7_embedding_near_dedup": embeddings.query,
        "op8_substring_dedup": substrings.query,
        "op9_line_dedup": lines.query,
        "op10_source_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": licenses.ORACLE_SQL,
        "op7_embedding_near_dedup": embeddings.ORACLE_SQL,
        "op8_substring_dedup": substrings.ORACLE_SQL,
        "op9_line_dedup": lines.ORACLE_SQL,
        "op10_source_mixing": mixing.ORACLE_SQL,
    }
