"""The list of runnable queries, each with the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from answerlake.plans.derived import VIEWS, Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan builder under an inventory id, with its SQL statement if there is one."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = build
        if sql is not None:
            _SQL[name] = sql
        return build

    return add


def with_views(sql: str) -> str:
    """Put the derived views the statement uses in front of it as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if re.search(rf"\b{view}\b", text) and view not in needed:
                visit(VIEWS[view])
                if view not in needed:
                    needed.append(view)

    visit(sql)
    parts = [f"{view} AS ({VIEWS[view]})" for view in needed]
    body = sql.strip().rstrip(";")
    recursive = ""
    if re.match(r"(?i)with\s", body):
        body = re.sub(r"(?i)^with\s+", "", body, count=1)
        if re.match(r"(?i)recursive\s", body):
            recursive, body = "RECURSIVE ", re.sub(r"(?i)^recursive\s+", "", body, count=1)
        return f"WITH {recursive}{', '.join(parts + [body])}" if parts else f"WITH {recursive}{body}"
    return f"WITH {', '.join(parts)} {body}" if parts else body


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build):
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {name: runner(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _SQL.items()}
