"""All registered queries: name to (Spark builder, SQL text or None)."""

from __future__ import annotations

from ledgerloom.plans import (
    queries_checks,
    queries_ledger,
    queries_sources,
    queries_text,
)

MODULES = (queries_ledger, queries_checks, queries_text, queries_sources)


def all_queries() -> dict[str, tuple]:
    merged: dict[str, tuple] = {}
    for module in MODULES:
        merged |= module.QUERIES
    return merged
