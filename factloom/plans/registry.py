"""All queries of the engine's own operators and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "top_facts_per_category"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with equivalent SQL where one can be written."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


from factloom.plans import audits, events, facts, joins, lifecycle, texts  # noqa: E402, F401
