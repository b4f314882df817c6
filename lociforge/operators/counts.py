"""Counts per sample and locus, and the sparse site table.

calls: sample, chrom, pos, locus, code (ref, het, alt, miss), dp. A position of a locus
without a row is missing; its count is the locus length less the called positions, so
missing positions are never spread out into rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_length(loci: DataFrame) -> DataFrame:
    return loci.withColumn("length", F.col("end") - F.col("start"))


def counts_per_locus(calls: DataFrame, loci: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample, locus, n_het, n_alt, n_ref, n_miss, mean_dp, n_dp) of every sample and locus.

    mean_dp and n_dp are of called genotypes with a depth. The pairs are the result's own
    rows: one for each sample and locus.
    """
    called = F.col("code") != "miss"
    n = lambda c: F.count_if(F.col("code") == c).alias(f"n_{c}")
    dp = F.when(called, F.col("dp"))
    own = calls.groupBy("sample", "locus").agg(n("het"), n("alt"), n("ref"), F.avg(dp).alias("mean_dp"), F.count(dp).alias("n_dp"))
    lengths = with_length(loci).select("locus", "length")
    pairs = samples.select("sample").join(F.broadcast(lengths) if small(lengths) else lengths)
    rows = pairs.join(own, ["sample", "locus"], "left").fillna(0, ["n_het", "n_alt", "n_ref", "n_dp"])
    n_miss = F.col("length") - F.col("n_het") - F.col("n_alt") - F.col("n_ref")
    return rows.select("sample", "locus", "n_het", "n_alt", "n_ref", n_miss.alias("n_miss"), "mean_dp", "n_dp")


def small(df: DataFrame, limit: int = 100_000) -> bool:
    """Whether df has few enough rows to be broadcast."""
    return df.limit(limit + 1).count() <= limit


def variable_counters(calls: DataFrame, loci: DataFrame) -> DataFrame:
    """Per sample: rows of each code that is not ref, their mean number per locus, and loci without a variable site."""
    n = {c: F.count_if(F.col("code") == c).alias(f"n_{c}") for c in ("het", "alt", "miss")}
    total = loci.count()
    variable = F.count_distinct(F.when(F.col("code").isin("het", "alt"), F.col("locus")))
    rows = calls.groupBy("sample").agg(*n.values(), (F.lit(total) - variable).alias("n_loci_without"))
    return rows.select("*", *[F.try_divide(f"n_{c}", F.lit(total)).alias(f"mean_{c}") for c in n])


def depth_per_sample(calls: DataFrame) -> DataFrame:
    called = F.when(F.col("code") != "miss", F.col("dp"))
    return calls.groupBy("sample").agg(F.avg(called).alias("mean_dp"), F.count(called).alias("n_dp"))


def fill_missing_positions(calls: DataFrame, loci: DataFrame, samples: DataFrame) -> DataFrame:
    """The sparse table (sample, chrom, pos, locus, code) with a miss row for each absent position.

    For exchange with tools that need such rows; the statistics here use counts instead.
    """
    places = loci.select("chrom", "locus", F.explode(F.sequence(F.col("start") + 1, F.col("end"))).alias("pos"))
    absent = samples.select("sample").join(places).join(calls.select("sample", "chrom", "pos"), ["sample", "chrom", "pos"], "left_anti")
    absent = absent.withColumn("code", F.lit("miss")).select("sample", "chrom", "pos", "locus", "code")
    return calls.filter("code <> 'ref'").select("sample", "chrom", "pos", "locus", "code").unionByName(absent)


def counts_bed_layout(loci: DataFrame, counts: DataFrame, sample: object) -> DataFrame:
    """One sample's counts in the order of the intervals, zeros where it has none."""
    own = counts.filter(F.col("sample") == F.lit(sample)).drop("sample")
    return loci.join(own, "locus", "left").fillna(0, ["n_het", "n_alt", "n_ref", "n_dp"]).orderBy("chrom", "start", "locus")
