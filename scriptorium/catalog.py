"""Registry of queries: each names the survey's operators that it covers and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    ops: tuple[str, ...]
    sql: str | None


_entries: dict[str, Entry] = {}


def query(*ops: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        _entries[f.__name__] = Entry(f, ops, sql)
        return f

    return add


def _load() -> dict[str, Entry]:
    from scriptorium.plans import load

    load()
    return _entries


def queries() -> dict[str, Query]:
    return {k: e.run for k, e in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in _load().items() if e.sql}


def coverage() -> dict[str, list[str]]:
    """Queries by operator of the survey."""
    out: dict[str, list[str]] = {}
    for k, e in _load().items():
        for op in e.ops:
            out.setdefault(op, []).append(k)
    return out
