"""The checked queries, grouped by the operators they exercise."""

import importlib

MODULES = ["report_queries", "ingest_queries", "search_queries", "alert_queries", "model_queries", "stream_queries"]


def load_queries():
    for name in MODULES:
        importlib.import_module(f"logweave.plans.{name}")
    from logweave.plans.base import QUERIES, SQL
    return QUERIES, SQL
