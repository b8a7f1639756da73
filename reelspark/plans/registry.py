"""Registered queries: one per SURVEY §2 operator, each (spark, sf_dir) -> DataFrame, with
its DuckDB oracle SQL when the result is SQL-expressible.

Every query reads the input tables (through the fixture views) in full; parameters are
fixed here so the Spark job and the SQL compute the same thing.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_catalog, q_features, q_metadata, q_models, q_quality, q_recommend, q_search, q_sources, q_taste  # noqa: F401
