"""All queries of the library and the SQL they are checked by.

A query is registered with ``query(name, sql)``; its SQL may name the graph
fixture's tables ``nodes`` and ``edges``, which are put in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "D08_table_impact"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with its SQL if SQL can express it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = with_fixture(sql)
        return fn

    return add


def with_fixture(sql: str) -> str:
    from .plans import fixture

    views = [(n, s) for n, s in fixture.VIEWS.items() if re.search(rf"\b{n}\b", sql)]
    needed = dict(views)
    for _, s in views:  # a view's own views come first
        needed = {n: t for n, t in fixture.VIEWS.items() if n in needed or re.search(rf"\b{n}\b", s)}
    if not needed:
        return sql
    bodies = ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', s)})" for n, s in needed.items())
    body = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE):
        return f"WITH RECURSIVE {bodies},\n{body[m.end():]}"
    return f"WITH RECURSIVE {bodies}\n{body}"


from . import catalog  # noqa: E402, F401  (fills the registry)
