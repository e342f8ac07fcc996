"""All queries of the core engine with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.plans import general_queries, kb_queries, more_queries, store_queries

_MODULES = [general_queries, kb_queries, more_queries, store_queries]
flagship = kb_queries.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
