"""A hub of calls that statistics by site and locus read without a shuffle.

Calls lie in a table bucketed by locus and sorted by locus and position, so that grouping by
(locus, ...) finds its rows together. Samples are added in lots; a sample that the hub has is not added again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("sample", "chrom", "pos", "locus", "code", "dp")


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def add_samples(calls: DataFrame, name: str, path: str, buckets: int = 200) -> None:
    """Adds the samples of calls that the hub lacks; path is a folder that all executors see, for the first lot.

    calls: sample, chrom, pos, locus, code, dp. Every lot adds a file to each bucket.
    """
    spark = calls.sparkSession
    rows = calls.select(*COLUMNS)
    if exists(spark, name):
        rows = rows.join(samples(spark, name), "sample", "left_anti").select(*COLUMNS)
        buckets = _buckets(spark, name)
    rows = rows.repartition(buckets, "locus")  # by the hash of the buckets: one file each
    rows.write.bucketBy(buckets, "locus").sortBy("locus", "pos").mode("append").option("path", path).saveAsTable(name)


def _buckets(spark: SparkSession, name: str) -> int:
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe extended {name}").collect()}
    return int(told["Num Buckets"])


def samples(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).select("sample").distinct()


def read_hub(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def drop(spark: SparkSession, name: str) -> None:
    """Forgets the hub; its files stay."""
    spark.sql(f"drop table if exists {name}")
