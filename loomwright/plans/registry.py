"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.plans import corpus_queries, version_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [version_queries, corpus_queries]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.ORACLES
    return found
