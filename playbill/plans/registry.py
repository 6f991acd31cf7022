"""Registry of the queries that run over the driver's tables."""

from __future__ import annotations

from playbill.session import ship

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function and, where there is one, its SQL twin."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(ship(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap
