"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from docspark.plans import assembly_queries, control_queries, fair_queries, fold_queries, page_queries, quality_queries, source_queries, streaming_queries, sweep_queries
from docspark.plans.entry import Entries

ALL = Entries()
for _part in (control_queries, fair_queries, source_queries, page_queries, assembly_queries, quality_queries, streaming_queries, fold_queries, sweep_queries):
    ALL.take(_part.ENTRIES)

QUERIES: dict[str, Callable] = ALL.queries
ORACLES: dict[str, str] = ALL.oracles
