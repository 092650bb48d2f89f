"""The queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe_codec, license_scan, ngram_join, packing, progressive_jpeg, quality_lm, substring_dedup, url_filter, vector_search, warc_store

MODULES = [ngram_join, license_scan, packing, warc_store, bpe_codec, quality_lm, vector_search, url_filter, progressive_jpeg, substring_dedup]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLES.items()}
