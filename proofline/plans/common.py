"""What query modules share: a registry, and inputs stated once for both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Queries by name, each with the SQL that must agree with it."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def plain(sql: str) -> str:
    """Input SQL for an engine that has the tables as views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def carried(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of input SQL whose tables stand in braces.

    Inputs that the driver's tables lack are derived from all their rows by
    SQL of the subset that Spark and DuckDB read alike.
    """
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
