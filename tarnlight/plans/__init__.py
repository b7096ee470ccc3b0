"""The relational queries by name, each with the DuckDB SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnlight.plans import aggregates, extras, joins, searches, sets, streams, texts, windows

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = (
    joins.QUERIES | aggregates.QUERIES | windows.QUERIES | sets.QUERIES | texts.QUERIES | searches.QUERIES | extras.QUERIES | streams.QUERIES
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan for name, (plan, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
