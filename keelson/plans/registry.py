"""Registered queries: an operator applied to whole tables, and its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *inputs: str, sql: str | None = None):
    """Register ``f(*inputs)`` as query ``name``; ``sql`` names its views as ``{view}``."""

    def add(f: Callable[..., DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, i) for i in inputs))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add
