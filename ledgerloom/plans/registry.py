"""All queries over the warehouse tables and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import catalog_queries, evidence_queries, gate_queries, ledger_queries, page_queries

_ALL = ledger_queries.QUERIES | catalog_queries.QUERIES | page_queries.QUERIES | evidence_queries.QUERIES | gate_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
