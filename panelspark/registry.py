"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["w2_w3_r1_daily_metrics"](spark, sf_dir)


from panelspark.plans import chains, cross_sections, dated, events, factors, feeds, horizons, joins, learning, news, panels, parts, peers, published, research, risk, scans, snapshots, states, stored, strategies  # noqa: E402, F401
