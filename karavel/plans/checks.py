"""How queries are registered: a function of the input tables and the SQL that gives the same rows."""

from __future__ import annotations


def collector() -> tuple[dict, object]:
    """An empty register and the decorator that fills it, as name -> (function, SQL or None)."""
    found: dict = {}

    def check(sql: str | None = None):
        def add(f):
            found[f.__name__] = (f, sql)
            return f

        return add

    return found, check
