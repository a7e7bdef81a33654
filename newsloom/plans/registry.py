"""Registry of named queries and of the SQL each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
# Shared pieces of oracle text: name of a common table expression -> its SELECT.
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may use the names in CTES as tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def oracle_text(body: str) -> str:
    """Put the common table expressions that `body` needs, directly or not, in front of it."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(sql: str) -> None:
        words = set(re.findall(r"[A-Za-z_0-9]+", sql))
        for name in CTES:
            if name in words and name not in seen:
                seen.add(name)
                visit(CTES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
