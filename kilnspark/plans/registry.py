"""All queries of the ledger, collection, audit, layout and media operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(t), where t(table name) reads a table of the data folder."""

    def add(f: Callable):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


from kilnspark.plans import ledger_queries, page_queries, sequence_queries, stream_queries  # noqa: E402,F401
