"""Registered queries over the given tables, with their DuckDB equivalents."""

from __future__ import annotations


def _load() -> None:
    from keelson.plans import functions_q, pairs_q, history_q, matching_q, markets_q, ingest_q  # noqa: F401, I001


def all_queries():
    from keelson.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from keelson.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
