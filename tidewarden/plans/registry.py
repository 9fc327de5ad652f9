"""All registered queries outside the training-data package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewarden.plans import json_queries, more_queries, policy_queries, record_queries, rewrite_queries, scan_queries, stateful_queries, stream_queries

_MODULES = [scan_queries, rewrite_queries, record_queries, stream_queries, stateful_queries, more_queries, policy_queries, json_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {n: f for m in _MODULES for n, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    """SQL with the same results, where SQL can express them."""
    return {n: s for m in _MODULES for n, s in m.oracle_sql().items()}
