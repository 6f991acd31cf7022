"""Queries over the driver's tables."""

from importlib import import_module

MODULES = ["catalogue_queries", "search_queries", "log_queries", "matching_queries", "page_queries", "candidate_queries"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"playbill.plans.{name}")
