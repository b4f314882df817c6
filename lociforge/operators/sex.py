"""Sex from depth on the sex chromosome, and classes of its loci."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.operators.ranks import with_rank
from lociforge.operators.stored import stored


def depth_long(counts: DataFrame, sex_loci: DataFrame) -> DataFrame:
    """(sample, locus, is_sex, mean_dp, n_dp): sex loci one by one, all others as one row weighted by sites (locus null)."""
    rows = counts.join(sex_loci.select("locus").distinct().withColumn("_sex", F.lit(True)), "locus", "left")
    rows = rows.withColumn("is_sex", F.coalesce("_sex", F.lit(False)))
    key = F.when(F.col("is_sex"), F.col("locus"))
    return rows.groupBy("sample", key.alias("locus"), "is_sex").agg(
        F.try_divide(F.sum(F.col("mean_dp") * F.col("n_dp")), F.sum("n_dp")).alias("mean_dp"), F.sum("n_dp").alias("n_dp")
    )


def ratio_of(depths: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(sample, auto_depth, sex_depth, depth_ratio) of depth_long, of the sex loci in ``only`` if given; the ratio only where both depths are positive."""
    rows = depths
    if only is not None:
        rows = rows.filter("not is_sex").unionByName(rows.filter("is_sex").join(only.select("locus").distinct(), "locus", "left_semi").select(*rows.columns))
    mean = lambda c: F.try_divide(F.sum(F.when(c, F.col("mean_dp") * F.col("n_dp"))), F.sum(F.when(c, F.col("n_dp"))))
    out = rows.groupBy("sample").agg(mean(~F.col("is_sex")).alias("auto_depth"), mean(F.col("is_sex")).alias("sex_depth"))
    both = (F.col("auto_depth") > 0) & (F.col("sex_depth") > 0)
    return out.withColumn("depth_ratio", F.when(both, F.col("sex_depth") / F.col("auto_depth")))


def depth_ratio(counts: DataFrame, sex_loci: DataFrame, only: DataFrame | None = None) -> DataFrame:
    return ratio_of(depth_long(counts, sex_loci), only)


def split_at_gap(ratios: DataFrame, column: str = "depth_ratio") -> DataFrame:
    """ratios with sex: samples below the largest gap in the middle 60 % are hetero, the others homo.

    Of equal gaps the first counts.
    """
    ranked = with_rank(ratios.filter(F.col(column).isNotNull()), column, "sample", into="_i", total="_n")
    after = ranked.select((F.col("_i") - 1).alias("_i"), F.col(column).alias("_next"))
    ranked = ranked.join(after, "_i", "left").withColumn("_gap", F.col("_next") - F.col(column)).drop("_next")
    low = F.greatest(F.floor(0.2 * F.col("_n")), F.lit(1))
    high = F.least(F.floor(0.8 * F.col("_n")), F.col("_n") - 1)
    cut = ranked.filter(F.col("_i").between(low, high)).agg(F.max_by("_i", F.struct("_gap", -F.col("_i"))).alias("_cut"))
    sex = F.when(F.col("_i") <= F.col("_cut"), "hetero").otherwise("homo")
    return ranked.join(F.broadcast(cut)).withColumn("sex", sex).select(*ratios.columns, "sex")


def classify_sex_loci(
    calls: DataFrame, loci: DataFrame, sexes: DataFrame, max_het_frac: float = 0.6, min_call_frac: float = 0.25,
    max_site_frac: float = 0.05, min_sites: int = 3, hemizygous: float = 0.6,
) -> DataFrame:
    """Per sex locus: excess sites and het density in either sex, their ratio, and the class of the locus."""
    sizes = {r["sex"]: r["n"] for r in sexes.groupBy("sex").agg(F.count("*").alias("n")).collect()}  # two rows
    sites = calls.join(sexes.select("sample", "sex"), "sample").groupBy("sex", "locus", "chrom", "pos").agg(
        F.count_if(F.col("code") == "het").alias("n_het"), F.count_if(F.col("code") != "miss").alias("called")
    )
    size = F.when(F.col("sex") == "hetero", sizes.get("hetero", 0)).otherwise(sizes.get("homo", 0))
    scored = (F.col("called") > 0) & (F.col("called") >= min_call_frac * size)
    excess = scored & (F.col("n_het") / F.col("called") > max_het_frac)
    own = sites.groupBy("locus").pivot("sex", ["hetero", "homo"]).agg(
        F.count_if(scored).alias("n_sites"), F.count_if(excess).alias("n_excess"), F.sum("n_het").alias("total_het")
    )
    names = [f"{s}_{c}" for s in ("hetero", "homo") for c in ("n_sites", "n_excess", "total_het")]
    rows = loci.select("locus", (F.col("end") - F.col("start")).alias("length")).join(own, "locus", "left").fillna(0, names)
    for s in ("hetero", "homo"):
        rows = rows.withColumns({
            f"{s}_site_frac": F.coalesce(F.try_divide(f"{s}_n_excess", f"{s}_n_sites"), F.lit(0.0)),
            f"{s}_het_density": F.coalesce(F.try_divide(f"{s}_total_het", F.lit(sizes.get(s, 0)) * F.col("length")), F.lit(0.0)),
        })
    a, b = F.col("hetero_het_density"), F.col("homo_het_density")
    rows = rows.withColumn("het_ratio", F.when(b > 0, F.try_divide(a, b)).when(a > 0, 999.0).otherwise(1.0))
    high = lambda s: (F.col(f"{s}_site_frac") > max_site_frac) & (F.col(f"{s}_n_excess") >= min_sites)
    kind = (
        F.when(high("hetero") & high("homo"), "paralog")
        .when(high("hetero"), "gametolog")
        .when(F.col("het_ratio") <= hemizygous, "hemizygous")
        .otherwise("PAR-like")
    )
    return rows.withColumn("class", kind).drop("hetero_total_het", "homo_total_het")


def sex_loci(loci: DataFrame, chrom: str) -> DataFrame:
    """The loci of one chromosome; an error if there are none."""
    own = loci.filter(F.col("chrom") == chrom)
    if own.isEmpty():
        raise ValueError(f"no locus lies on {chrom!r}")
    return own


def exclusion_list(classes: DataFrame, policy: str) -> DataFrame:
    """(locus) to leave out: all sex loci, gametologs and paralogs (``paralogs``), gametologs alone, or none."""
    kinds = {"all": None, "paralogs": ["gametolog", "paralog"], "gametologs": ["gametolog"], "none": []}
    if policy not in kinds:
        raise ValueError(f"policy {policy!r} is not one of {', '.join(kinds)}")
    wanted = kinds[policy]
    return classes.select("locus") if wanted is None else classes.filter(F.col("class").isin(wanted) if wanted else F.lit(False)).select("locus")


def robust_z(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """df with <column>_z: distance to the group's median by 1.4826 of its median deviation; 0 where that is 0."""
    mid = df.groupBy(by).agg(*[F.median(c).alias(f"_{c}_m") for c in columns])
    rows = df.join(mid, by)
    away = rows.select("*", *[F.abs(F.col(c) - F.col(f"_{c}_m")).alias(f"_{c}_d") for c in columns])
    spread = away.groupBy(by).agg(*[(1.4826 * F.median(f"_{c}_d")).alias(f"_{c}_s") for c in columns])
    out = away.join(spread, by)
    z = {f"{c}_z": F.coalesce(F.try_divide(f"_{c}_d", f"_{c}_s"), F.lit(0.0)) for c in columns}
    return out.withColumns(z).drop(*[f"_{c}_{x}" for c in columns for x in "mds"])


def sex_statistics(counts: DataFrame, loci: DataFrame, sexes: DataFrame, classes: DataFrame) -> DataFrame:
    """sexes with het_density over hemizygous loci (of their length), hemi_depth, their mean depth, and n_gametolog_het; 0 where there is no such locus."""
    length = F.col("end") - F.col("start")
    own = counts.join(classes.filter(F.col("class").isin("hemizygous", "gametolog")).select("locus", "class"), "locus")
    own = own.join(loci.select("locus", length.alias("_length")), "locus")
    hemi, het = F.col("class") == "hemizygous", F.col("n_het")
    rows = own.groupBy("sample").agg(
        F.try_divide(F.sum(F.when(hemi, het)), F.sum(F.when(hemi, F.col("_length")))).alias("het_density"),
        F.try_divide(F.sum(F.when(hemi, F.col("mean_dp") * F.col("n_dp"))), F.sum(F.when(hemi & F.col("mean_dp").isNotNull(), F.col("n_dp")))).alias("hemi_depth"),
        F.sum(F.when(~hemi, het)).alias("n_gametolog_het"),
    )
    return sexes.join(rows, "sample", "left").fillna(0, ["het_density", "hemi_depth", "n_gametolog_het"])


#: Statistics that flag a sample far from the rest of its sex, with the names of their flags.
SEX_CHECKS = {"depth_ratio": "depth_ratio", "het_density": "het_density", "n_gametolog_het": "gametolog_hets"}


def sex_calls(samples: DataFrame, checks: dict[str, str] = SEX_CHECKS, min_depth: float = 15, max_z: float = 3) -> DataFrame:
    """samples (sample, sex, auto_depth, the columns of checks) with flags (``-`` if none) and confident."""
    rows = robust_z(samples, list(checks), "sex")
    told = lambda name, what, x: F.concat(F.lit(f"{name}({what}"), F.format_string("%.1f", F.col(x)), F.lit(")"))
    flags = [F.when(F.coalesce(F.col("auto_depth"), F.lit(0.0)) < min_depth, told("low_depth", "", "auto_depth"))]
    flags += [F.when(F.col(f"{c}_z") > max_z, told(name, "z=", f"{c}_z")) for c, name in checks.items()]
    joined = F.concat_ws(",", *flags)
    return rows.withColumns({"flags": F.when(joined == "", "-").otherwise(joined), "confident": joined == ""})


def n_switched(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: samples that two assignments (sample, sex) give different sexes."""
    both = a.select("sample", "sex").join(b.select("sample", F.col("sex").alias("_b")), "sample")
    return both.agg(F.count_if(F.col("sex") != F.col("_b")).alias("n_switched"))


def two_passes(counts: DataFrame, calls: DataFrame, sex_loci: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """Sexes and locus classes: from all sex loci, then again from those the first pass finds hemizygous, if any.

    Both are stored, and so is what the passes share; nothing stays cached.
    """
    own_calls = calls.join(sex_loci.select("locus"), "locus", "left_semi")
    own_calls = stored(own_calls.select("sample", "locus", "chrom", "pos", "code"), "sex-calls")
    depths = stored(depth_long(counts, sex_loci), "depths")  # sex loci only, and one row a sample for the rest
    first = stored(split_at_gap(ratio_of(depths)), "sexes")  # a row a sample
    classes = stored(classify_sex_loci(own_calls, sex_loci, first, **limits), "classes")  # a row a sex locus
    only = classes.filter(F.col("class") == "hemizygous").select("locus")
    if only.isEmpty():
        return first, classes
    second = stored(split_at_gap(ratio_of(depths, only)), "sexes")
    return second, stored(classify_sex_loci(own_calls, sex_loci, second, **limits), "classes")
