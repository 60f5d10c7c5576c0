"""Named queries that exercise the library on the benchmark tables."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from heddlework.plans.catalog import QUERIES, SQL
from heddlework.session import apply_settings

for _name in ("values", "graphs", "runs", "enrichment", "arrivals"):
    import_module(f"heddlework.plans.{_name}")


def _with_settings(fn):
    @wraps(fn)
    def run(spark, folder):
        apply_settings(spark)
        return fn(spark, folder)

    return run


def all_queries():
    return {name: _with_settings(fn) for name, fn in QUERIES.items()}


def all_sql():
    return dict(SQL)
