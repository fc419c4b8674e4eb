"""Registration of named queries and of the SQL they are checked against.

SQL texts may use the shared views below by name; only the views a text needs
are put in front of it.  ``r6(...)`` stands for rounding to six digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellshift.sources.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    """Declare a shared SQL view (a common table expression)."""
    VIEWS[name] = body.strip()


def query(name: str, sql: str | None = None):
    """Register ``fn(star) -> DataFrame`` under a name, with an optional SQL equivalent."""

    def register(fn: Callable[[Star], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Star(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _rounded(text: str) -> str:
    while True:
        start = re.search(r"\br6\(", text)
        if start is None:
            return text
        depth, position = 1, start.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[position], 0)
            position += 1
        inner = text[start.end() : position - 1]
        text = f"{text[: start.start()]}(round(CAST({inner} AS DOUBLE), 6) + 0.0){text[position:]}"


def _needed(text: str, found: dict[str, None]) -> None:
    for name in re.findall(r"\bv_\w+", text):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found.setdefault(name)


def resolved_sql(name: str) -> str:
    """Full SQL text of a registered query: needed views first, then its body."""
    body = ORACLES[name].strip()
    found: dict[str, None] = {}
    _needed(body, found)
    parts = [f"{item} AS (\n{VIEWS[item]}\n)" for item in found]
    recursive = bool(re.match(r"WITH RECURSIVE\b", body, flags=re.I))
    if recursive:
        body = re.sub(r"^WITH RECURSIVE\s", "", body, flags=re.I)
        parts_text = ",\n".join(parts)
        text = f"WITH RECURSIVE {parts_text + ',' if parts else ''}\n{body}"
    elif re.match(r"WITH\b", body, flags=re.I):
        body = re.sub(r"^WITH\s", "", body, flags=re.I)
        parts_text = ",\n".join(parts)
        text = f"WITH {parts_text + ',' if parts else ''}\n{body}"
    else:
        text = (f"WITH {', '.join(parts)}\n" if parts else "") + body
    return _rounded(text)
