"""All registered queries: name -> (builder over ``Views``, SQL text or None)."""

from __future__ import annotations

from tidemark.workload import market, operations, storage, text


def all_queries() -> dict:
    return {**market.QUERIES, **operations.QUERIES, **text.QUERIES, **storage.QUERIES}
