"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyspark.llm import alignment, byte_bpe, chat_format, chat_repair, packing, piece_bpe, pii, quality_classifier, quality_rules, simhash, top_k, toxicity, url_filter

MODULES = [quality_rules, top_k, quality_classifier, simhash, pii, toxicity, byte_bpe, packing, chat_format, url_filter, piece_bpe, alignment, chat_repair]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return dict(m.QUERY for m in MODULES) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {m.QUERY[0]: m.SQL for m in MODULES if hasattr(m, "SQL")}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
