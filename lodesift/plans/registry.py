"""A small registry, so that a query stands beside its SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
