"""Named queries over the given tables, each with the plain SQL it must agree with, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def register(function: Query) -> Query:
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load_all() -> None:
    from forecourt.plans import (  # noqa: F401
        anomaly_queries, dedup_queries, image_queries, ingest_queries, listing_queries, market_queries,
        page_queries, price_queries, spec_queries, store_queries, text_queries, url_queries,
    )
