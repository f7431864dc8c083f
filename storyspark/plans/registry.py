"""All registered queries of the library, with their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["story_queries", "log_queries", "eval_queries", "briefing_queries", "research_queries", "retrieval_queries", "card_queries", "stream_queries"]


def registered() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out = {}
    for m in MODULES:
        out |= import_module(f"storyspark.plans.{m}").QUERIES
    return out
