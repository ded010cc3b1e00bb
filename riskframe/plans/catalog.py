"""Query catalog: one entry per operator key.

Each entry is a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where the operator
has an exact SQL form, the DuckDB oracle text.  Column names and types of both sides are
kept identical so the driver's value hashes agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a catalog query under ``key`` (with its oracle SQL when exact)."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so the decorators run."""
    import importlib
    import pkgutil

    import riskframe.plans as plans
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"riskframe.plans.{m.name}")


def all_queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    load_all()
    from riskframe.plans.oracle import with_views
    return {k: with_views(v) for k, v in ORACLE.items()}
