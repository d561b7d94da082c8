"""Registry of named queries and their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
CHECKS: dict[str, str] = {}
#: Shared sub-queries of the check SQL, by name.
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def _needed(sql: str, found: list[str]) -> list[str]:
    for name, text in PARTS.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(text, found)
            if name not in found:
                found.append(name)
    return found


def check_sql(body: str) -> str:
    """``body`` with the shared sub-queries it names in front of it."""
    names = _needed(body, [])
    if not names:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in names) + "\n" + body


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query; ``sql`` is the same result in plain SQL."""

    def register(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run

    return register
