"""Consensus sequences, column statistics, end trimming, missingness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.functions.genotypes import iupac, percent, safe_name
from lociforge.operators.counts import small, with_length
from lociforge.operators.ranks import with_rank

#: Positions of a run of a consensus sequence that is put together at once.
RUN = 10_000


def consensus(calls: DataFrame, loci: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample, locus, seq) of every sample and locus: REF, ALT or the IUPAC code of both, N where nothing is called.

    calls: sample, locus, pos, ref, alt (strings of one base), code. Several records of a position count as one if
    those that are called agree on the letter, else the position is N. Positions outside of their locus are left out.
    Called letters are sorted and joined in runs of RUN positions, then the runs, so no array is longer than that.
    """
    base = (
        F.when(F.col("code") == "ref", F.col("ref"))
        .when(F.col("code") == "alt", F.col("alt"))
        .when(F.col("code") == "het", iupac(F.col("ref"), F.col("alt")))
        .otherwise("N")
    )
    places = loci.select("locus", F.col("start").alias("_start"), (F.col("end") - F.col("start")).cast("int").alias("_n"))
    own = calls.select("sample", "locus", "pos", base.alias("base")).filter("base <> 'N'")
    own = own.groupBy("sample", "locus", F.floor(F.col("pos") / RUN).alias("_run")).agg(F.sort_array(F.collect_set(F.struct(F.col("pos").alias("at"), F.col("base").alias("text")))).alias("_items"))
    own = own.select("sample", "locus", F.struct(F.col("_items")[0]["at"].alias("at"), _assembled(F.col("_items")).alias("text")).alias("_item"))
    own = own.groupBy("sample", "locus").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    own = own.select("sample", "locus", F.col("_items")[0]["at"].alias("_at"), _assembled(F.col("_items")).alias("_text"))
    rows = samples.select("sample").join(F.broadcast(places) if small(places) else places).join(own, ["sample", "locus"], "left")
    first = F.col("_start") + 1
    inside = F.when(F.col("_at") < first, F.substr("_text", (first - F.col("_at") + 1).cast("int"))).otherwise(
        F.concat(F.repeat(F.lit("N"), F.least(F.col("_at") - first, F.col("_n")).cast("int")), "_text")
    )
    return rows.select("sample", "locus", F.rpad(F.coalesce(inside, F.lit("")), F.col("_n"), F.lit("N")).alias("seq"))


def _assembled(items: Column) -> Column:
    """Texts at places, in order, joined with N for each place between them; several letters at one place give N."""
    n = F.size(items)
    none = F.array(F.lit(None).cast("struct<at:bigint,text:string>"))
    shifted = F.arrays_zip(items.alias("it"), F.slice(F.concat(none, items), 1, n).alias("last"), F.concat(F.slice(items, 2, n), none).alias("next"))

    def part(x: Column) -> Column:
        it, last, after = x["it"], x["last"], x["next"]
        gap = F.coalesce(it["at"] - last["at"] - F.length(last["text"]), F.lit(0)).cast("int")
        text = F.when(it["at"] == after["at"], "N").otherwise(it["text"])
        return F.when(it["at"] == last["at"], "").otherwise(F.concat(F.repeat(F.lit("N"), gap), text))

    return F.array_join(F.transform(shifted, part), "")


def pct_n(seq) -> object:
    """Percent of N; 100 for an empty sequence."""
    n = F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))
    return F.coalesce(percent(n, F.length(seq)), F.lit(100.0))


def missingness_per_sample(seqs: DataFrame) -> DataFrame:
    """Mean of the percentages over loci, not pooled.

    Percentages are summed with 26 decimals and the mean is rounded to a double once, so it does not depend on the order
    of the loci, and samples of equal missingness have equal values.
    """
    n = F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))
    share = F.when(F.length("seq") > 0, (100 * n.cast("long")).cast("decimal(38,26)") / F.length("seq").cast("decimal(10,0)")).otherwise(F.lit(100))
    mean = F.sum(share.cast("decimal(38,26)")) / F.count("*").cast("decimal(20,0)")
    return seqs.groupBy("sample").agg(mean.cast("double").alias("mean_pct_n"), F.count("*").alias("n_loci"))


def missingness_per_locus(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy("locus").agg(F.avg(pct_n(F.col("seq"))).alias("mean_pct_n"), F.max(F.length("seq")).alias("length"))


def keep_samples(stats: DataFrame, max_pct: float = 10) -> DataFrame:
    return stats.filter(F.col("mean_pct_n") <= max_pct).select("sample")


def keep_loci(stats: DataFrame, max_pct: float = 20, min_length: int = 150) -> DataFrame:
    return stats.filter((F.col("mean_pct_n") <= max_pct) & (F.col("length") >= min_length)).select("locus")


def filter_alignments(seqs: DataFrame, max_sample_pct: float = 10, max_locus_pct: float = 20, min_length: int = 150) -> DataFrame:
    """seqs of kept samples and loci; the loci are judged on the samples that are kept."""
    kept = seqs.join(keep_samples(missingness_per_sample(seqs), max_sample_pct), "sample", "left_semi")
    return kept.join(keep_loci(missingness_per_locus(kept), max_locus_pct, min_length), "locus", "left_semi")


def column_stats(seqs: DataFrame) -> DataFrame:
    """(locus, col, n, n_gap, gap, n_bases, site_class) of each alignment column, N being a gap.

    informative: two bases with two copies or more each; constant: one base, at least two
    copies; singleton: several bases, not informative; other: the rest.
    """
    letters = F.filter(F.split("seq", ""), lambda x: x != "")
    cells = seqs.select("locus", F.posexplode(letters).alias("col", "base"))
    bases = cells.groupBy("locus", "col", "base").agg(F.count("*").alias("k"))
    known = F.col("base") != "N"
    rows = bases.groupBy("locus", "col").agg(
        F.sum("k").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("k"))), F.lit(0)).alias("n_gap"),
        F.count_if(known).alias("n_bases"), F.count_if(known & (F.col("k") >= 2)).alias("_twice"),
    )
    kind = (
        F.when(F.col("_twice") >= 2, "informative")
        .when((F.col("n_bases") == 1) & (F.col("_twice") == 1), "constant")
        .when(F.col("n_bases") > 1, "singleton")
        .otherwise("other")
    )
    return rows.select("locus", (F.col("col") + 1).alias("col"), "n", "n_gap", (F.col("n_gap") / F.col("n")).alias("gap"), "n_bases", kind.alias("site_class"))


def trim_ranges(columns: DataFrame, max_gap: float = 0.25) -> DataFrame:
    """Per locus the first and last column that is kept; a locus whose columns all go stays whole."""
    keep = F.col("gap") <= max_gap
    rows = columns.groupBy("locus").agg(F.count("*").alias("n"), F.min(F.when(keep, F.col("col"))).alias("first_kept"), F.max(F.when(keep, F.col("col"))).alias("last_kept"))
    failed = F.col("first_kept").isNull()
    rows = rows.select(
        "locus", "n", F.coalesce("first_kept", F.lit(1)).alias("first_kept"), F.coalesce("last_kept", "n").cast("int").alias("last_kept"), failed.alias("trim_failed")
    )
    kept = F.col("last_kept") - F.col("first_kept") + 1
    return rows.withColumns({"n_kept": kept, "n_trimmed": F.col("n") - kept, "pct_trimmed": percent(F.col("n") - kept, F.col("n"))})


def trim_ends(seqs: DataFrame, ranges: DataFrame) -> DataFrame:
    rows = seqs.join(ranges.select("locus", "first_kept", "n_kept"), "locus")
    return rows.withColumn("seq", F.substr("seq", F.col("first_kept"), F.col("n_kept").cast("int"))).drop("first_kept", "n_kept")


def trimmed_bed(loci: DataFrame, ranges: DataFrame) -> DataFrame:
    """Intervals of what trimming left."""
    rows = loci.join(ranges.select("locus", "first_kept", "last_kept"), "locus")
    return rows.select("chrom", (F.col("start") + F.col("first_kept") - 1).alias("start"), (F.col("start") + F.col("last_kept")).alias("end"), "locus")


def consensus_summary(seqs: DataFrame, loci: DataFrame) -> DataFrame:
    """Per sample: loci, bases, mean percent of N, loci that are all N, and loci whose length is not the interval's."""
    rows = seqs.join(with_length(loci).select("locus", F.col("length").alias("_length")), "locus", "left")
    return rows.groupBy("sample").agg(
        F.count("*").alias("n_loci"), F.sum(F.length("seq")).alias("n_bp"), F.avg(pct_n(F.col("seq"))).alias("mean_pct_n"),
        F.count_if(pct_n(F.col("seq")) == 100).alias("n_all_n"), F.count_if(~F.col("_length").eqNullSafe(F.length("seq"))).alias("n_mismatch"),
    )


def seq_lengths(seqs: DataFrame, key: str = "locus") -> DataFrame:
    """(key, length) of each sequence."""
    return seqs.select(key, F.length("seq").alias("length"))


def samples_by_missingness(stats: DataFrame, place: str | None = None) -> DataFrame:
    """Samples with their missingness, the most incomplete first; place: a column for the places, of rows in no order."""
    order = (F.desc("mean_pct_n"), F.col("sample"))
    return stats.orderBy(*order) if place is None else with_rank(stats, *order, into=place)


def length_summary(seqs: DataFrame) -> DataFrame:
    n = F.length("seq")
    return seqs.agg(F.min(n).alias("min"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.max(n).alias("max"))


def locus_file_names(loci: DataFrame) -> DataFrame:
    """(locus, file_name): safe names, a second locus of a name with __2 and so on."""
    safe = loci.select("locus").distinct().withColumn("_safe", safe_name(F.col("locus").cast("string")))
    k = F.row_number().over(Window.partitionBy("_safe").orderBy("locus"))
    return safe.select("locus", F.when(k == 1, F.col("_safe")).otherwise(F.concat("_safe", F.lit("__"), k.cast("string"))).alias("file_name"))
