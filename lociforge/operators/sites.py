"""Informative sites, per-sample variant statistics, depth around probes, coverage on target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.functions.genotypes import balance, distance_bin, is_transition, judged, length_class
from lociforge.operators.counts import with_length
from lociforge.operators.intervals import overlaps, restrict_to
from lociforge.operators.ranks import with_rank

#: Bases of a bin in which positions and probes meet.
OVERLAP_BIN = 2_000


def locus_informativeness(calls: DataFrame, loci: DataFrame, n_samples: int, min_call_frac: float = 0.25) -> DataFrame:
    """Per locus: scored, variable, informative and singleton sites, and their shares of the scored (null without any)."""
    alt = F.col("code").isin("het", "alt")
    sites = calls.groupBy("locus", "pos").agg(F.count_if(alt).alias("a"), F.count_if(F.col("code") != "miss").alias("called"))
    r = F.col("called") - F.col("a")
    sites = sites.filter((F.col("called") > 0) & (F.col("called") >= min_call_frac * n_samples))
    variable = (F.col("a") > 0) & (r > 0)
    own = sites.groupBy("locus").agg(
        F.count("*").alias("n_scored"), F.count_if(variable).alias("n_variable"),
        F.count_if((F.col("a") >= 2) & (r >= 2)).alias("n_pi"), F.count_if(variable & (F.least("a", r) == 1)).alias("n_singleton"),
    )
    rows = with_length(loci).select("locus", "length").join(own, "locus", "left").fillna(0, ["n_scored", "n_variable", "n_pi", "n_singleton"])
    return rows.select("*", *[F.try_divide(f"n_{x}", "n_scored").alias(f"prop_{x}") for x in ("variable", "pi", "singleton")])


def informativeness_totals(loci: DataFrame) -> DataFrame:
    total = {c: F.sum(c).alias(c) for c in ("n_scored", "n_variable", "n_pi", "n_singleton")}
    rows = loci.agg(F.count("*").alias("n_loci"), *total.values(), F.count_if(F.col("n_variable") == 0).alias("n_without"))
    return rows.select("*", *[F.try_divide(100 * F.col(f"n_{x}"), F.col("n_scored")).alias(f"pct_{x}") for x in ("variable", "pi", "singleton")])


def cumulative_share(loci: DataFrame, column: str = "n_pi") -> DataFrame:
    """(locus, rank, share): loci by descending count, and the share of the total up to each."""
    ranked = with_rank(loci.select("locus", column), F.desc(column), "locus", running={column: "_upto"})
    whole = loci.agg(F.sum(column).alias("_whole"))
    return ranked.join(F.broadcast(whole)).select("locus", F.col("rank").cast("int").alias("rank"), F.try_divide("_upto", "_whole").alias("share"))


def allele_counts(calls: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, ac, an): copies of the ALT allele and called alleles over all samples."""
    copies = F.when(F.col("code") == "het", 1).when(F.col("code") == "alt", 2).otherwise(0)
    return calls.filter("code <> 'miss'").groupBy("chrom", "pos", "ref", "alt").agg(F.sum(copies).alias("ac"), (2 * F.count("*")).alias("an"))


def sample_variant_stats(calls: DataFrame, samples: DataFrame, bed: DataFrame | None = None) -> DataFrame:
    """Per sample: genotype counts, transitions and transversions of non-reference genotypes, singletons, indels, mean depth.

    calls: sample, chrom, pos, ref, alt, code, dp; REF and ALT of unequal length are an indel,
    which counts for neither transitions nor transversions. A singleton is an allele with one
    copy in all samples; only such sites are joined back. bed restricts all of it.
    """
    if bed is not None:
        calls = restrict_to(calls.drop("locus"), bed)
    variant = F.col("code").isin("het", "alt")
    indel = F.coalesce(F.length("ref") != F.length("alt"), F.lit(False))
    single = allele_counts(calls).filter("ac = 1").select("chrom", "pos", "ref", "alt").withColumn("_single", F.lit(1))
    ts = is_transition(F.col("ref"), F.col("alt"))
    base = calls.groupBy("sample").agg(
        *[F.count_if(F.col("code") == c).alias(f"n_{c}") for c in ("ref", "het", "alt", "miss")],
        F.count_if(variant & ~indel & ts).alias("n_ts"), F.count_if(variant & ~indel & ~ts).alias("n_tv"),
        F.count_if(variant & indel).alias("n_indels"), F.avg(F.when(F.col("code") != "miss", F.col("dp"))).alias("mean_dp"),
    )
    carriers = calls.filter("code = 'het'").join(single, ["chrom", "pos", "ref", "alt"]).groupBy("sample").agg(F.count("*").alias("n_singletons"))
    rows = samples.select("sample").join(base, "sample", "left").join(carriers, "sample", "left")
    rows = rows.fillna(0, ["n_ref", "n_het", "n_alt", "n_miss", "n_ts", "n_tv", "n_indels", "n_singletons"])
    return rows.withColumn("ts_tv", F.try_divide("n_ts", "n_tv"))


#: Codes in a site's vector, by their number; missing ones are not stored.
CODES = ("ref", "het", "alt")


def numbered(samples: DataFrame) -> DataFrame:
    """(sample, number): each sample once, numbered from 0 by name."""
    return with_rank(samples.select("sample").distinct(), "sample").select("sample", (F.col("rank") - 1).cast("int").alias("number"))


def merge_samples(calls: DataFrame, numbers: DataFrame) -> DataFrame:
    """(chrom, pos, ref, carriers, codes): each site once, with the numbers of the samples called there, ascending, and their codes.

    calls: sample, chrom, pos, ref, code; numbers is numbered() samples, calls of others are left out. codes has places
    in CODES. Samples that are missing at a site are in neither array; a site where all are missing
    has empty arrays. Of several records of a sample and REF each allele place takes an ALT if one
    has it there, so alt is before het and het before ref; records of several ALTs or REFs are made one
    by calls.merge_records before. A site holds an integer for each called sample.
    """
    code = F.array_position(F.array(*map(F.lit, CODES)), F.col("code")) - 1  # -1: missing
    own = calls.select("sample", "chrom", "pos", "ref", code.cast("int").alias("code")).join(numbers, "sample")
    own = own.groupBy("chrom", "pos", "ref", "number").agg(F.max("code").alias("code"))
    cell = F.when(F.col("code") >= 0, F.col("number") * len(CODES) + F.col("code"))
    return _vectors(own.groupBy("chrom", "pos", "ref").agg(F.sort_array(F.collect_list(cell)).alias("cells")))


def _vectors(rows: DataFrame) -> DataFrame:
    k = len(CODES)
    carriers = F.transform("cells", lambda x: F.floor(x / k).cast("int"))
    return rows.select("chrom", "pos", "ref", carriers.alias("carriers"), F.transform("cells", lambda x: (x % k).cast("tinyint")).alias("codes"))


def join_sites(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sites of two sets of merged samples with one numbering as one, so samples can be added to a cohort without their calls."""
    cells = F.zip_with("carriers", "codes", lambda x, c: x * len(CODES) + c)
    rows = a.unionByName(b).select("chrom", "pos", "ref", cells.alias("cells"))
    rows = rows.groupBy("chrom", "pos", "ref").agg(F.sort_array(F.flatten(F.collect_list("cells"))).alias("cells"))
    # of a sample that both have, the greatest code is last
    follows = F.concat(F.slice("cells", 2, F.size("cells")), F.array(F.lit(None).cast("int")))
    kept = F.filter(F.arrays_zip(F.col("cells").alias("x"), follows.alias("y")), lambda z: z["x"].isNotNull() & (z["y"].isNull() | (F.floor(z["x"] / len(CODES)) != F.floor(z["y"] / len(CODES)))))
    return _vectors(rows.withColumn("cells", F.transform(kept, lambda z: z["x"])))


def site_calls(merged: DataFrame, numbers: DataFrame) -> DataFrame:
    """(sample, chrom, pos, ref, code): the called genotypes of merged sites, one row each."""
    pairs = F.explode(F.arrays_zip(F.col("carriers").alias("number"), F.col("codes").alias("code")))
    rows = merged.select("chrom", "pos", "ref", pairs.alias("_c")).select("chrom", "pos", "ref", "_c.number", "_c.code")
    return rows.join(numbers, "number").select("sample", "chrom", "pos", "ref", F.get(F.array(*map(F.lit, CODES)), F.col("code").cast("int")).alias("code"))


def depth_profiles(calls: DataFrame, probes: DataFrame, buffer: int = 300, bin: int = 50, long_from: int = 600) -> DataFrame:
    """(class, region, bin, n_pos, n_called, mean_dp, call_frac): records, called ones, their mean depth and share.

    By probe class and distance to the nearer probe edge (region null), and by class and region,
    probe or flank (bin null), from one join. calls: chrom, pos, code, dp. Distances are 1 and up inside the probe,
    0 and down outside. A position near several probes counts for the one whose edge is nearest, then the first.
    """
    wide = probes.select("chrom", F.greatest(F.col("start") - buffer, F.lit(0)).alias("start"), (F.col("end") + buffer).alias("end"), "locus",
                         F.col("start").alias("_s"), F.col("end").alias("_e"))
    points = calls.select("chrom", "pos").distinct().select("chrom", "pos", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    rows = overlaps(points, wide, bin=OVERLAP_BIN)
    dist = F.least(F.col("pos") - F.col("b__s"), F.col("b__e") - F.col("pos") + 1)
    rows = rows.withColumns({"dist": dist, "class": length_class(F.col("b__e") - F.col("b__s"), long_from)})
    nearest = rows.groupBy("chrom", "pos").agg(F.min_by(F.struct("dist", "class"), F.struct(F.abs("dist"), "b_start", "b_locus")).alias("_r"))
    nearest = calls.select("chrom", "pos", "code", "dp").join(nearest, ["chrom", "pos"]).select("_r.*", "code", "dp")
    called = (F.col("code") != "miss") & F.col("dp").isNotNull()
    region = F.when(F.col("dist") > 0, "probe").otherwise("flank")
    nearest = nearest.select("class", region.alias("region"), distance_bin(F.col("dist"), bin).alias("bin"), called.alias("_called"), F.when(called, F.col("dp")).alias("dp"))
    c, r, b = (F.col(x) for x in ("class", "region", "bin"))
    out = nearest.groupingSets([[c, b], [c, r]], c, r, b).agg(F.count("*").alias("n_pos"), F.count_if("_called").alias("n_called"), F.avg("dp").alias("mean_dp"))
    return out.withColumn("call_frac", F.col("n_called") / F.col("n_pos"))


def depth_profile(calls: DataFrame, probes: DataFrame, buffer: int = 300, bin: int = 50, long_from: int = 600, by_region: bool = False) -> DataFrame:
    """depth_profiles by distance, or by region only."""
    rows = depth_profiles(calls, probes, buffer, bin, long_from)
    return rows.filter("bin is null").drop("bin") if by_region else rows.filter("region is null").drop("region")


def thin_bins(profile: DataFrame, share: float = 0.1) -> DataFrame:
    """Bins with at least a share of the median number of positions of their class."""
    mid = profile.groupBy("class").agg(F.median("n_pos").alias("_mid"))
    return profile.join(mid, "class").filter(F.col("n_pos") >= share * F.col("_mid")).drop("_mid")


def on_target_stats(windows: DataFrame, targets: DataFrame, genome_dp: Column | None = None) -> DataFrame:
    """Per sample: bases on target, all bases, their percentage, mean depth of the targets, enrichment over genome_dp."""
    on = overlaps(windows, targets).groupBy("sample").agg(F.sum(F.col("depth") * F.col("overlap")).alias("on_target_bp"), F.count("*").alias("n_overlaps"))
    span = targets.agg(F.sum(F.col("end") - F.col("start")).alias("_span"))
    whole = windows.groupBy("sample").agg(F.sum(F.col("depth") * (F.col("end") - F.col("start"))).alias("total_bp"))
    rows = whole.join(on, "sample", "left").fillna(0, ["on_target_bp", "n_overlaps"]).join(F.broadcast(span))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = rows.withColumns({"pct_on_target": zero(100.0 * F.col("on_target_bp"), F.col("total_bp")), "target_mean_dp": zero(F.col("on_target_bp"), F.col("_span"))})
    if genome_dp is not None:
        rows = rows.withColumn("enrichment", zero(F.col("target_mean_dp"), genome_dp))
    return rows.drop("_span")


def nearest_indel(sites: DataFrame) -> DataFrame:
    """sites (sample, chrom, pos, is_indel, ...) with the distance to the nearest indel of their sample and chromosome.

    Two running windows, one in each direction.
    """
    by = Window.partitionBy("sample", "chrom")
    at = F.when(F.col("is_indel"), F.col("pos"))
    before = F.last(at, ignorenulls=True).over(by.orderBy("pos").rangeBetween(Window.unboundedPreceding, 0))
    after = F.last(at, ignorenulls=True).over(by.orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, 0))
    return sites.withColumn("indel_dist", F.least(F.col("pos") - before, after - F.col("pos")))


#: Upper bounds of the distance classes to an indel, and the name of each; beyond the last is the background.
DISTANCES = {3: "1-3", 5: "4-5", 10: "6-10", 20: "11-20", 50: "21-50", 100: "51-100", 200: "101-200"}


def rates_by_indel_distance(sites: DataFrame) -> DataFrame:
    """(distance, n_callable, n_snps, snps_per_kb, rel_rate, pct_het, rel_het) of records that are no indel, called and with a distance.

    sites: sample, chrom, pos, is_indel, code. Rates are by callable records of the class; rel_
    columns are by those of the background, beyond the last class.
    """
    own = nearest_indel(sites).filter(~F.col("is_indel") & (F.col("code") != "miss") & (F.coalesce("indel_dist", F.lit(1 << 40)) > 0))
    kind = F.when(F.lit(False), "")
    for upto, name in DISTANCES.items():
        kind = kind.when(F.col("indel_dist") <= upto, name)
    snp = F.col("code").isin("het", "alt")
    rows = own.groupBy(kind.otherwise("background").alias("distance")).agg(
        F.count("*").alias("n_callable"), F.count_if(snp).alias("n_snps"),
        F.try_divide(1000 * F.count_if(snp), F.count("*")).alias("snps_per_kb"), F.try_divide(100 * F.count_if(F.col("code") == "het"), F.count_if(snp)).alias("pct_het"),
    )
    base = rows.filter("distance = 'background'").select(F.col("snps_per_kb").alias("_rate"), F.col("pct_het").alias("_het"))
    rows = rows.join(F.broadcast(base), how="left")  # one row
    return rows.withColumns({"rel_rate": F.try_divide("snps_per_kb", "_rate"), "rel_het": F.try_divide("pct_het", "_het")}).drop("_rate", "_het")


def blanked_by_gap(sites: DataFrame, gaps: tuple[int, ...] = (0, 3, 5, 10)) -> DataFrame:
    """(gap, n_sites, n_blanked): variant sites other than indels that each gap would blank."""
    own = nearest_indel(sites).filter(~F.col("is_indel") & F.col("is_variant"))
    rows = own.withColumn("gap", F.explode(F.array(*[F.lit(g) for g in gaps])))
    near = F.coalesce(F.col("indel_dist") <= F.col("gap"), F.lit(False)) & (F.col("gap") > 0)
    return rows.groupBy("gap").agg(F.count("*").alias("n_sites"), F.count_if(near).alias("n_blanked"))


def _drawn(sample: Column, seed: int) -> Column:
    """A hash that other engines have too: md5 of ``<seed>:<sample>``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), sample.cast("string")))


def rarefied(samples: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n samples in the order of a seeded hash."""
    return samples.select("sample").orderBy(_drawn(F.col("sample"), seed), "sample").limit(n)


def rarefaction(calls: DataFrame, loci: DataFrame, samples: DataFrame, sizes: tuple[int, ...], seed: int = 0, min_call_frac: float = 0.25) -> DataFrame:
    """(n, n_scored, n_variable, n_pi, pct_variable, pct_pi): informative sites of the first n samples in the order of a seeded hash.

    The sets are nested, so one pass does: calls are counted by site and band (samples that a size
    adds to the one before), and a size's counts are those of its bands. Sizes beyond the samples count as asked for.
    """
    sizes = sorted(set(sizes))
    band = F.size(F.filter(F.array(*map(F.lit, sizes)), lambda n: n < F.col("rank"))).alias("band")
    drawn = with_rank(samples.select("sample").distinct().withColumn("_h", _drawn(F.col("sample"), seed)), "_h", "sample").filter(F.col("rank") <= sizes[-1])
    own = calls.join(loci.select("locus").distinct(), "locus", "left_semi").join(drawn.select("sample", band), "sample")
    alt = F.col("code").isin("het", "alt")
    bands = own.filter("code <> 'miss'").groupBy("locus", "pos", "band").agg(F.count_if(alt).alias("a"), F.count("*").alias("called"))
    of = lambda c: [F.sum(F.when(F.col("band") <= k, F.col(c)).otherwise(0)) for k in range(len(sizes))]
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, sizes)).alias("n"), F.col("a").alias("a"), F.col("called").alias("called"))).alias("s")
    rows = bands.groupBy("locus", "pos").agg(F.array(*of("a")).alias("a"), F.array(*of("called")).alias("called")).select(each).select("s.*")
    rows = rows.filter((F.col("called") > 0) & (F.col("called") >= min_call_frac * F.col("n")))
    r = F.col("called") - F.col("a")
    totals = rows.groupBy("n").agg(F.count("*").alias("n_scored"), F.count_if((F.col("a") > 0) & (r > 0)).alias("n_variable"), F.count_if((F.col("a") >= 2) & (r >= 2)).alias("n_pi"))
    asked = calls.sparkSession.createDataFrame([(n,) for n in sizes], "n int")
    totals = asked.join(totals, "n", "left").fillna(0, ["n_scored", "n_variable", "n_pi"])
    return totals.select("*", *[F.try_divide(100 * F.col(f"n_{x}"), F.col("n_scored")).alias(f"pct_{x}") for x in ("variable", "pi")])


def balance_by_tolerance(hets: DataFrame, tolerances: tuple[int, ...] = (0, 1, 2, 3), low: float = 0.25, high: float = 0.75) -> DataFrame:
    """(tolerance, n_het, pct_unjudged, pct_blanked): heterozygotes (ao, ro, dp) that can't be judged, and of the others those outside of [low, high]."""
    rows = hets.withColumn("tolerance", F.explode(F.array(*[F.lit(t) for t in tolerances])))
    ok = judged(F.col("ao"), F.col("ro"), F.col("dp"), F.col("tolerance"))
    ab = balance(F.col("ao"), F.col("ro"))
    out = ok & ((ab < low) | (ab > high))
    return rows.groupBy("tolerance").agg(
        F.count("*").alias("n_het"), F.try_divide(100 * F.count_if(~ok), F.count("*")).alias("pct_unjudged"),
        F.try_divide(100 * F.count_if(out), F.count_if(ok)).alias("pct_blanked"),
    )
