"""Cohort filters: excess heterozygosity per site and locus, skewed allele balance, exclusion lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.operators.counts import with_length
from lociforge.operators.ranks import with_rank


def per_site_het(calls: DataFrame, n_samples: int) -> DataFrame:
    """(locus, chrom, pos, n_het, n_miss, called, f) of sites with a row; absent rows are missing."""
    called = F.count_if(F.col("code") != "miss")
    sites = calls.groupBy("locus", "chrom", "pos").agg(F.count_if(F.col("code") == "het").alias("n_het"), called.alias("called"))
    return sites.select(
        "locus", "chrom", "pos", "n_het", (F.lit(n_samples) - F.col("called")).alias("n_miss"), "called",
        F.coalesce(F.try_divide("n_het", "called"), F.lit(0.0)).alias("f"),
    )


def per_locus_het(sites: DataFrame, loci: DataFrame, n_samples: int, max_het_frac: float = 0.6, min_call_frac: float = 0.25) -> DataFrame:
    """Per locus: length, scored and excess sites, their share, the greatest f scored, and het density over all sites."""
    scored = (F.col("called") > 0) & (F.col("called") >= min_call_frac * n_samples) if min_call_frac > 0 else F.lit(True)
    own = sites.groupBy("locus").agg(
        F.count_if(scored).alias("n_sites"), F.count_if(scored & (F.col("f") > max_het_frac)).alias("n_excess"),
        F.max(F.when(scored, F.col("f"))).alias("max_site_het_frac"), F.sum("n_het").alias("total_het"),
    )
    rows = with_length(loci).select("locus", "length").join(own, "locus", "left").fillna(0, ["n_sites", "n_excess", "total_het"])
    return rows.select(
        "locus", "length", "n_sites", "n_excess",
        F.coalesce(F.try_divide("n_excess", "n_sites"), F.lit(0.0)).alias("site_frac"),
        F.coalesce("max_site_het_frac", F.lit(0.0)).alias("max_site_het_frac"),
        "total_het", F.try_divide("total_het", F.lit(n_samples) * F.col("length")).alias("het_density"),
    )


def excess_het_loci(calls: DataFrame, loci: DataFrame, n_samples: int, max_het_frac: float = 0.6, min_call_frac: float = 0.25) -> DataFrame:
    return per_locus_het(per_site_het(calls, n_samples), loci, n_samples, max_het_frac, min_call_frac)


def flag_excess_het(stats: DataFrame, max_site_frac: float = 0.05, min_sites: int = 3) -> DataFrame:
    return stats.filter((F.col("site_frac") > max_site_frac) & (F.col("n_excess") >= min_sites))


def ab_skew(het_ab: DataFrame, min_hets: int = 5, cutoff: float = 0.4) -> DataFrame:
    """Per locus: samples with enough judged heterozygotes, and those whose exact median balance is low."""
    own = het_ab.filter("status <> 'exempt'").groupBy("locus", "sample").agg(F.count("*").alias("n"), F.median("ab").alias("ab"))
    own = own.filter(F.col("n") >= min_hets).groupBy("locus").agg(F.count("*").alias("n_ab_samples"), F.count_if(F.col("ab") < cutoff).alias("n_skewed"))
    return own.withColumn("skew_frac", F.col("n_skewed") / F.col("n_ab_samples"))


def attach_ab(stats: DataFrame, skew: DataFrame | None) -> DataFrame:
    """stats with the balance columns: null where balance was not run, 0 where a locus has no counted sample."""
    names = {"n_ab_samples": "bigint", "n_skewed": "bigint", "skew_frac": "double"}
    if skew is None:
        return stats.select("*", *[F.lit(None).cast(t).alias(c) for c, t in names.items()])
    return stats.join(skew.select("locus", *names), "locus", "left").fillna(0, list(names))


def flag_ab_skew(stats: DataFrame, max_frac: float = 0.5, min_samples: int = 20) -> DataFrame:
    return stats.filter((F.col("n_ab_samples") >= min_samples) & (F.col("skew_frac") > max_frac))


def blacklist(excess: DataFrame, skewed: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(locus): loci of any of the lists."""
    rows = excess.select("locus").union(skewed.select("locus"))
    return (rows if excluded is None else rows.union(excluded.select("locus"))).distinct()


def flagged_by_both(excess: DataFrame, skewed: DataFrame) -> DataFrame:
    return excess.select("locus").intersect(skewed.select("locus"))


def removal_list(*lists: DataFrame) -> DataFrame:
    """(sample): those of any of the lists, once each."""
    rows = lists[0].select("sample")
    for x in lists[1:]:
        rows = rows.union(x.select("sample"))
    return rows.distinct()


def first_samples(samples: DataFrame, n: int) -> DataFrame:
    """The first n samples by name, for a quick run."""
    return samples.select("sample").distinct().orderBy("sample").limit(n)


def drop_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(column).distinct(), column, "left_anti")


def percentiles_floor(df: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """(share, value): the value with floor(n * share) smaller ones."""
    ranked = with_rank(df.select(F.col(column).alias("value")), "value", total="n").withColumn("k", F.col("rank") - 1)
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    return ranked.withColumn("share", wanted).filter(F.col("k") == F.least(F.floor(F.col("n") * F.col("share")), F.col("n") - 1)).select("share", "value")
