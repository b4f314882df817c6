"""Wide and long quality tables, stage labels, watch lists and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.functions.genotypes import percent


def locus_from_counts(counts: DataFrame) -> DataFrame:
    """Per locus: samples, those that call it, depth and call fraction over samples, mean heterozygotes."""
    called = F.col("n_het") + F.col("n_alt") + F.col("n_ref")
    share = F.try_divide(called, called + F.col("n_miss"))
    return counts.withColumn("_called", called).withColumn("_share", share).groupBy("locus").agg(
        F.count("*").alias("n_samples"), F.count_if(F.col("_called") > 0).alias("n_samples_called"),
        F.avg("mean_dp").alias("mean_dp"), F.min("mean_dp").alias("min_dp"),
        F.avg("_share").alias("mean_call_frac"), F.stddev_samp("_share").alias("sd_call_frac"), F.min("_share").alias("min_call_frac"),
        F.avg("n_het").alias("mean_n_het"),
    )


def sample_from_counts(counts: DataFrame) -> DataFrame:
    """Per sample: loci called, mean percent missing (of loci), pooled percent of heterozygotes, depth over called sites."""
    called = F.col("n_het") + F.col("n_alt") + F.col("n_ref")
    return counts.groupBy("sample").agg(
        F.count_if(called > 0).alias("n_loci_called"),
        F.avg(100 * (1 - F.try_divide(called, called + F.col("n_miss")))).alias("mean_pct_n"),
        F.try_divide(100 * F.sum("n_het"), F.sum(called)).alias("pct_het"),
        F.try_divide(F.sum(F.col("mean_dp") * F.col("n_dp")), F.sum("n_dp")).alias("mean_dp"),
    )


def ab_summary(het_ab: DataFrame) -> DataFrame:
    return het_ab.groupBy("sample").agg(F.count("*").alias("n_het"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("kept", "blanked", "exempt")])


def ab_per_sample(het_ab: DataFrame, low: float = 0.35) -> DataFrame:
    """Per sample, of judged heterozygotes: how many, percent blanked, median balance, percent below low."""
    own = het_ab.filter("status <> 'exempt'").groupBy("sample")
    return own.agg(
        F.count("*").alias("n_judged"), F.try_divide(100 * F.count_if(F.col("status") == "blanked"), F.count("*")).alias("pct_blanked"),
        F.median("ab").alias("median_ab"), F.try_divide(100 * F.count_if(F.col("ab") < low), F.count("*")).alias("pct_low_ab"),
    )


def stage_label(rules: list[tuple[str | Column, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.when(F.lit(False), "")
    for name, rule in rules:
        out = out.when(F.coalesce(rule, F.lit(False)), name)
    return out.otherwise(otherwise)


def stage_locus(df: DataFrame, min_length: int = 150) -> DataFrame:
    """df (locus, retained, excess_het, ab_skew, z_class, length, kept_missing) with the stage at which a locus went."""
    rules = [
        ("retained", F.col("retained")), ("excess het", F.col("excess_het")), ("allele balance", F.col("ab_skew")),
        (F.concat(F.lit("Z ("), "z_class", F.lit(")")), F.col("z_class").isNotNull()), ("too short", F.col("length") < min_length), ("missingness", ~F.col("kept_missing")),
    ]
    return df.withColumn("stage", stage_label(rules, "other"))


def stage_sample(df: DataFrame, max_pct: float = 10) -> DataFrame:
    """df (sample, retained, contam, mean_pct_n) with the stage at which a sample went."""
    rules = [("retained", F.col("retained")), ("flagged contaminant", F.col("contam")), ("missingness", F.col("mean_pct_n").isNotNull())]
    return df.withColumn("stage", stage_label(rules, "no data"))


def with_contam(meta: DataFrame, listed: DataFrame) -> DataFrame:
    """meta with contam also for samples of a list (sample), and contam_source: metadata, QC, or null."""
    rows = meta.join(listed.select("sample").distinct().withColumn("_qc", F.lit(True)), "sample", "left")
    own, qc = F.coalesce("contam", F.lit(False)), F.coalesce("_qc", F.lit(False))
    return rows.withColumns({"contam": own | qc, "contam_source": F.when(own, "metadata").when(qc, "QC")}).drop("_qc")


def join_optional(df: DataFrame, part: DataFrame | None, by: str, columns: str = "") -> DataFrame:
    """df with the columns of part; where part is None (its input is absent) with null ``columns`` (names and types)."""
    if part is not None:
        return df.join(part, by, "left")
    absent = T.StructType.fromDDL(columns) if columns else T.StructType()
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in absent])


def per_locus_table(missingness: DataFrame, lengths: DataFrame, kept: DataFrame, parts: list[DataFrame | None], absent: list[str] = ()) -> DataFrame:
    """A row for each locus of missingness or lengths, also of those that are not kept.

    kept: (locus, ...) of the loci kept by missingness and length, told by kept_missing. parts: tables by
    locus; None where an input is absent, with its columns in ``absent`` at the same place.
    """
    rows = missingness.join(lengths, "locus", "full")
    rows = rows.join(kept.withColumn("kept_missing", F.lit(True)), "locus", "left").withColumn("kept_missing", F.coalesce("kept_missing", F.lit(False)))
    for part, columns in zip(parts, [*absent, *[""] * (len(parts) - len(absent))], strict=True):
        rows = join_optional(rows, part, "locus", columns)
    return rows


def per_sample_table(meta: DataFrame, retained: DataFrame, parts: list[DataFrame | None], absent: list[str] = ()) -> DataFrame:
    """A row for each sample of meta, with whether it is retained, from tables by sample; see per_locus_table."""
    rows = meta.join(retained.select("sample").distinct().withColumn("retained", F.lit(True)), "sample", "left")
    rows = rows.withColumn("retained", F.coalesce("retained", F.lit(False)))
    for part, columns in zip(parts, [*absent, *[""] * (len(parts) - len(absent))], strict=True):
        rows = join_optional(rows, part, "sample", columns)
    return rows


def depth_called_vs_target(df: DataFrame) -> DataFrame:
    """df (mean_dp, target_mean_dp) with their ratio: depth over called sites by that over whole targets."""
    return df.withColumn("dp_called_vs_target", F.try_divide("mean_dp", "target_mean_dp"))


def flagged_vs_retained(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Medians of metrics of retained and of flagged samples; others are left out."""
    group = F.when(F.col("retained"), "retained").when(F.col("contam"), "flagged")
    return group_summary(df.withColumn("group", group).filter("group is not null"), "group", [], metrics)


def depth_per_million(df: DataFrame, depth: str = "mean_dp", reads: str = "n_reads") -> DataFrame:
    return df.withColumn("dp_per_million", F.try_divide(1e6 * F.col(depth), F.col(reads)))


def counts_long(counts: DataFrame) -> DataFrame:
    """(sample, locus, metric, value, pct): n_miss in percent of the locus, the others of the called; n_diff = alt + het / 2."""
    called = F.col("n_het") + F.col("n_alt") + F.col("n_ref")
    wide = counts.select(
        "sample", "locus", called.alias("_called"), (called + F.col("n_miss")).alias("_length"),
        *[F.col(c).cast("double").alias(c) for c in ("n_het", "n_alt", "n_miss")], (F.col("n_alt") + F.col("n_het") / 2).cast("double").alias("n_diff"),
    )
    rows = wide.unpivot(["sample", "locus", "_called", "_length"], ["n_het", "n_alt", "n_diff", "n_miss"], "metric", "value")
    pct = F.when(F.col("metric") == "n_miss", percent(F.col("value"), F.col("_length"))).otherwise(percent(F.col("value"), F.col("_called")))
    return rows.withColumn("pct", pct).drop("_called", "_length")


def geno_per_sample(long: DataFrame) -> DataFrame:
    return long.groupBy("sample", "metric").agg(F.avg("pct").alias("mean_pct"))


def filtering_summary(steps: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(step, name, n_loci, n_samples) of named sets of loci and samples."""
    out = None
    for i, (name, loci, samples) in enumerate(steps):
        row = loci.agg(F.count("*").alias("n_loci")).join(samples.agg(F.count("*").alias("n_samples")))
        row = row.select(F.lit(i).alias("step"), F.lit(name).alias("name"), "n_loci", "n_samples")
        out = row if out is None else out.union(row)
    return out


def check_lengths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Loci (locus, length) to which two tables give different lengths."""
    other = b.select("locus", F.col("length").alias("other_length")).distinct()
    return a.select("locus", "length").distinct().join(other, "locus").filter("length <> other_length")


def append_missing(base: DataFrame, extra: DataFrame, key: str, keep: DataFrame) -> DataFrame:
    """base and those rows of extra whose key is in keep and not in base."""
    own = extra.join(keep.select(key).distinct(), key, "left_semi").join(base.select(key).distinct(), key, "left_anti")
    return base.unionByName(own, allowMissingColumns=True)


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().fillna(0)


#: Columns that are checked within a batch, and the side on which a sample stands out.
WATCHED = {
    "mean_dp": "low", "mean_pct_n": "high", "ts_tv": "low", "n_singletons": "high", "pct_duplication": "high",
    "pct_mapped": "low", "pct_blanked": "high", "median_ab": "low",
}


def watch_flags(df: DataFrame, by: str, checks: dict[str, str] = WATCHED, low: float = 0.05, high: float = 0.95, unsure: bool = False) -> DataFrame:
    """df with a flag per column of checks (``low``: under the group's quantile, ``high``: over it), and their number.

    Quantiles are exact, interpolated between neighbours. unsure: one more flag, for samples that are not
    confident.
    """
    wanted = {c: F.percentile(c, low if side == "low" else high).alias(f"_{c}_q") for c, side in checks.items()}
    rows = df.join(df.groupBy(by).agg(*wanted.values()), by)
    bad = {c: F.coalesce(F.col(c) < F.col(f"_{c}_q") if side == "low" else F.col(c) > F.col(f"_{c}_q"), F.lit(False)) for c, side in checks.items()}
    if unsure:
        bad["confident"] = F.coalesce(~F.col("confident"), F.lit(False))
    rows = rows.withColumns({f"flag_{c}": x for c, x in bad.items()}).drop(*[f"_{c}_q" for c in checks])
    n = sum((F.col(f"flag_{c}").cast("int") for c in bad), F.lit(0))
    return rows.withColumn("n_flags", n)


def failed_checks(df: DataFrame, checks: list[str]) -> DataFrame:
    """df with the names of the flags that are set, in the order of checks."""
    return df.withColumn("failed", F.concat_ws(", ", *[F.when(F.col(f"flag_{c}"), c) for c in checks]))


def watch_list(df: DataFrame, checks: list[str], at_least: int = 2) -> DataFrame:
    return failed_checks(df, checks).filter(F.col("n_flags") >= at_least).orderBy(F.desc("n_flags"), "sample")


def average_rank(df: DataFrame, column: str, by: str, into: str) -> DataFrame:
    """Rank within the group, ties sharing their mean rank."""
    first = F.rank().over(Window.partitionBy(by).orderBy(column))
    ties = F.count("*").over(Window.partitionBy(by, column))
    return df.withColumn(into, first + (ties - 1) / 2)


def group_summary(df: DataFrame, by: str, means: list[str], medians: list[str] = ()) -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in means], *[F.median(c).alias(f"median_{c}") for c in medians]
    )


def metric_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, min, median, max), a row per column."""
    one = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.median(c).cast("double").alias("median"), F.max(c).cast("double").alias("max")).alias(c) for c in columns])
    return one.unpivot([], columns, "metric", "r").select("metric", "r.min", "r.median", "r.max")


def corr_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row: Pearson's r of each pair, over rows that have both."""
    own = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    return df.agg(*[own(a, b).alias(f"r_{a}_{b}") for a, b in pairs])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(a), F.lit(False)).alias(a), F.coalesce(F.col(b), F.lit(False)).alias(b)).agg(F.count("*").alias("n"))


def group_sizes(df: DataFrame, groups: list[str], item: str) -> DataFrame:
    """df with n_items and a label ``group (n)``: distinct items of its group."""
    n = df.groupBy(*groups).agg(F.count_distinct(item).alias("n_items"))
    label = F.concat(F.concat_ws(" ", *[F.col(g).cast("string") for g in groups]), F.lit(" ("), F.col("n_items").cast("string"), F.lit(")"))
    return df.join(n, groups).withColumn("label", label)


def summary_line(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row: mean, least and greatest value and their keys, rows and those that are 0."""
    order = lambda sign: F.struct(sign * F.col(column), F.col(key))
    return df.agg(
        F.count("*").alias("n"), F.avg(column).alias("mean"), F.min(column).alias("least"), F.min_by(key, order(1)).alias("least_key"),
        F.max(column).alias("greatest"), F.min_by(key, order(-1)).alias("greatest_key"), F.count_if(F.col(column) == 0).alias("n_zero"),
    )


def lowest(df: DataFrame, column: str, key: str, n: int = 10, descending: bool = False) -> DataFrame:
    return df.orderBy(F.desc(column) if descending else F.asc(column), key).limit(n)


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unknown_ids(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.select(key).subtract(known.select(key))


def flagged_suspects(df: DataFrame, below: float = 0.4) -> DataFrame:
    """Flagged samples with a low median balance or an unsure sex, lowest balance first."""
    unsure = F.coalesce(~F.col("confident"), F.lit(True))
    return df.filter(F.col("flagged") & ((F.col("median_ab") < below) | unsure)).orderBy("median_ab", "sample")
