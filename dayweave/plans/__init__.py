"""Composed analyses and the registered queries."""

from importlib import import_module

QUERY_MODULES = [
    "calendar_queries",
    "expression_queries",
    "aggregate_queries",
    "rolling_queries",
    "interval_queries",
    "peak_queries",
    "statistics_queries",
    "lag_queries",
    "warning_queries",
    "heart_queries",
    "device_queries",
    "model_queries",
    "source_queries",
]


def load_queries():
    """(queries, oracles) after importing every query module."""
    from dayweave.plans import registry

    for name in QUERY_MODULES:
        import_module(f"dayweave.plans.{name}")
    return registry.QUERIES, registry.ORACLES
