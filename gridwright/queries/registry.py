"""Name -> (Spark query, oracle SQL)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridwright.queries.views import VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the common table expressions it names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    body = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    sql = sql.strip()
    if sql[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {body},\n{sql[15:]}"
    if sql[:5].upper() == "WITH ":
        return f"WITH {body},\n{sql[5:]}"
    return f"WITH {body}\n{sql}"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register
