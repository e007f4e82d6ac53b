"""Registry of the library's own queries: name -> Spark query, and SQL of the same rows where SQL can say it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Decorator that registers a query and, where another engine can say the same, its SQL."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep
