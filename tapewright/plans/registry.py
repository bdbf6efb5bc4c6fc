"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
PARTS: dict[str, str] = {}
_HELD: dict[tuple, DataFrame] = {}


def held(key: str, spark: SparkSession, sf: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table (bars, contexts, panel) built once per application."""
    slot = (key, spark.sparkContext.applicationId, sf)
    if slot not in _HELD:
        _HELD[slot] = make()
    return _HELD[slot]


def release() -> None:
    """Forget the derived tables, so that the next query builds its own."""
    _HELD.clear()


def part(name: str, body: str) -> None:
    """A named common table expression usable in any check."""
    PARTS[name] = body


def _needed(text: str, seen: list[str], inside: tuple[str, ...] = ()) -> None:
    for name in PARTS:
        if name in seen or name in inside:
            continue
        if re.search(rf"\b(from|join)\s+{name}\b", text, re.IGNORECASE):
            _needed(PARTS[name], seen, inside + (name,))
            seen.append(name)


def with_parts(body: str) -> str:
    """Prefix a statement with the expressions it uses, in order."""
    names: list[str] = []
    _needed(body, names)
    if not names:
        return body
    lead = "WITH RECURSIVE " if any("UNION ALL" in PARTS[n] for n in names) else "WITH "
    return lead + ",\n".join(f"{n} AS ({PARTS[n]})" for n in names) + "\n" + body


def query(name: str, check: str | None = None):
    """Register a query; `check` is the SQL giving the same rows."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return keep


def R(expr: str, places: int = 6) -> str:
    """SQL text: rounded, without negative zero."""
    return f"(round({expr}, {places}) + 0.0)"
