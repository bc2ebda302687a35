"""The registry of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        assert name not in QUERIES, name

        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Table times have no zone; they are read as UTC everywhere.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def load_all() -> None:
    from gaugeworks.plans import (  # noqa: F401
        queries_aggregate,
        queries_clean,
        queries_gateway,
        queries_ingest,
        queries_streams,
    )
