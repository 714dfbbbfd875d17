"""All queries of the engine by name, and their SQL for the oracle."""

from __future__ import annotations

import importlib

from .views import Store, oracle

MODULES = ("queries_graph", "queries_text", "queries_store", "queries_sources", "queries_support")


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Store(spark, sf_dir))) for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: oracle(sql) for m in _modules() for name, sql in m.ORACLES.items()}
