"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import bpe, embedding_dedup, exact_dedup, html_extract, mixing, quality, secrets, sharding, simhash, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_secret_scan": secrets.query,
    "op4_quality_classifier": quality.query,
    "op5_source_mixing": mixing.query,
    "op6_embedding_dedup": embedding_dedup.query,
    "op7_bpe": bpe.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_html_extraction": html_extract.query,
    "op10_sharding": sharding.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op3_secret_scan": secrets.ORACLE_SQL,
    "op5_source_mixing": mixing.ORACLE_SQL,
}
