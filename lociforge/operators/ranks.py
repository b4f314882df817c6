"""Ranks and running sums over a whole table without one task for all of it.

Rows are dealt by ranges of the sort keys and stored with the number of their range; counts and sums of the
ranges, one row each, go through the driver and come back as offsets of the ranks within a range.
"""

from __future__ import annotations

from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.operators.stored import stored


def with_rank(df: DataFrame, *keys: str | Column, into: str = "rank", total: str | None = None, running: dict[str, str] | None = None) -> DataFrame:
    """df with the place of each row, from 1, in the order of keys, which should tell all rows apart.

    running: names of numeric columns and of the columns for their sums up to and with the row, nulls counting
    as 0; total: a column for the number of rows. df is made once and stored.
    """
    spark, running = df.sparkSession, running or {}
    rows = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    rows = stored(rows, "ranked")
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in running]
    parts = sorted(rows.groupBy("_part").agg(F.count("*").alias("_n"), *sums).collect(), key=lambda r: r["_part"])  # a row a range
    kinds = {"_n": "bigint"} | {c: dict(rows.groupBy().agg(*sums).dtypes)[c] for c in running}
    none = {c: 0.0 if t == "double" else Decimal(0) if t.startswith("decimal") else 0 for c, t in kinds.items()}
    before = {c: list(accumulate((r[c] for r in parts), initial=none[c])) for c in kinds}
    fields = ", ".join(["_part int", *[f"`_before_{c}` {t}" for c, t in kinds.items()]])
    offsets = spark.createDataFrame([(r["_part"], *[before[c][k] for c in kinds]) for k, r in enumerate(parts)], fields)
    w = Window.partitionBy("_part").orderBy(*keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    named = {into: (F.row_number().over(w) + F.col("_before__n"))} | {
        name: F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto) + F.col(f"_before_{c}") for c, name in running.items()
    }
    rows = rows.join(F.broadcast(offsets), "_part").withColumns(named)  # offsets: a row a range
    if total:
        rows = rows.withColumn(total, F.lit(before["_n"][-1]).cast("bigint"))
    return rows.select(*df.columns, *named, *([total] if total else []))
