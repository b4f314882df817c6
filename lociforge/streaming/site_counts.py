"""Per-site counts of call files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counted_sites(calls: DataFrame) -> DataFrame:
    """(locus, chrom, pos, n_het, called) of a stream of calls; the state has a row for each site."""
    return calls.groupBy("locus", "chrom", "pos").agg(
        F.sum(F.when(F.col("code") == "het", 1).otherwise(0)).alias("n_het"), F.sum(F.when(F.col("code") != "miss", 1).otherwise(0)).alias("called")
    )


def count_arrivals(spark: SparkSession, path: str, schema, out: str, checkpoint: str) -> StreamingQuery:
    """Counts all Parquet files of path that are new since the last run, and writes the changed sites of each batch to out."""
    calls = spark.readStream.schema(schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counted_sites(calls).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
