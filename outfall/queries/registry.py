"""Name -> (Spark query, SQL check)."""

from __future__ import annotations

from collections.abc import Callable

from outfall.queries.inputs import VIEWS, Inputs

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str, *views: str) -> str:
    """``WITH view AS (...), ... body``; a body may bring its own CTEs after ``WITH``."""
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    text = body.strip()
    if not ctes:
        return text
    if text.upper().startswith("WITH "):
        return f"WITH {ctes}, {text[5:]}"
    return f"WITH {ctes} {text}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(inputs) -> DataFrame``; ``sql`` is the same result in DuckDB's dialect."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return register
