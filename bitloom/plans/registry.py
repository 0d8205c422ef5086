"""Where the modules of queries put them: (Spark, DuckDB SQL or None) by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        ALL[name or f.__name__] = (f, sql)
        return f

    return add
