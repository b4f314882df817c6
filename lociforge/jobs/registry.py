"""The queries over the views, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.jobs import views as v
from lociforge.operators.stored import new_folder

__all__ = ["ORACLE_SQL", "QUERIES", "new_folder", "query", "rounded", "sample_count"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query by its name; sql may begin with further views of a WITH clause."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with {v.SQL}, {sql}" if not sql.lstrip().startswith("select") else f"with {v.SQL} {sql}"
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sample_count(spark: SparkSession, d: str) -> int:
    return v.samples(spark, d).count()


