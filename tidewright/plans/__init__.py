"""Queries over the given tables, each with its SQL where SQL can say the same."""

from __future__ import annotations


class Plans(dict):
    """Queries by name; sql has the same result's SQL."""

    def __init__(self):
        super().__init__()
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(f):
            self[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register
