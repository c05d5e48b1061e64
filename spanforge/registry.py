"""Queries of the library's own operators, by name, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.plans import integrity, narration, reading, records, retrieval, screens, shots, spans, stateful, text, wording

PLANS = (spans, text, retrieval, integrity, stateful, wording, shots, narration, records, screens, reading)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
