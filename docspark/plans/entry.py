"""A register of queries: a function of (spark, sf_dir), and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable


class Entries:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        def note(f: Callable) -> Callable:
            if f.__name__ in self.queries:
                raise ValueError(f"{f.__name__} is registered twice")
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return note

    def take(self, other: Entries) -> None:
        both = self.queries.keys() & other.queries.keys()
        if both:
            raise ValueError(f"{sorted(both)} are registered twice")
        self.queries |= other.queries
        self.oracles |= other.oracles
