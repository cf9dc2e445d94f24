"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm import byte_bpe, centroids, extract, jaccard, language_id, nearest, packing, pieces_scan, prefix_trie, quality, sharding, substrings, toxicity

MODULES = (quality, pieces_scan, extract, jaccard, substrings, packing, language_id, sharding, toxicity, nearest, byte_bpe, prefix_trie, centroids)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # it imports the operators itself

    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    known = {name: text for module in MODULES for name, text in module.SQL.items()} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: text for name, text in known.items() if text}
