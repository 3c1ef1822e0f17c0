"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **types: str) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its oracle where SQL can express it.

    ``types`` casts columns of the oracle to the query's types.
    """

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if types else sql
        return f

    return put
