"""The genotype filter chain, on calls in long form.

Raw calls: sample, chrom, pos, ref, alt (array), qual, filter (array), gt (array of allele
numbers, null elements missing), dp, gq, ro, ao (array). A mask sets gt to null; the row stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.functions.genotypes import ab_status, genotype_code, percent


def _masked(calls: DataFrame, where: Column) -> DataFrame:
    """calls with gt null where the condition holds; null conditions don't."""
    return calls.withColumn("gt", F.when(F.coalesce(where, F.lit(False)), F.lit(None)).otherwise(F.col("gt")))


def split_blocks(calls: DataFrame) -> DataFrame:
    """One row per base of monomorphic records of several bases; all other fields are copied."""
    block = (F.size("alt") == 0) & (F.length("ref") > 1)
    bases = F.when(block, F.filter(F.split("ref", ""), lambda x: x != "")).otherwise(F.array("ref"))
    rest = [c for c in calls.columns if c not in ("pos", "ref")]
    rows = calls.select(*rest, F.col("pos").alias("_pos"), F.posexplode(bases).alias("_i", "ref"))
    return rows.withColumn("pos", F.col("_pos") + F.col("_i")).select(*calls.columns)


def mask_low_gt(calls: DataFrame, min_dp: int = 5, min_gq: float = 20) -> DataFrame:
    low = F.coalesce(F.col("dp") < min_dp, F.lit(False)) | F.coalesce(F.col("gq") < min_gq, F.lit(False))
    return _masked(calls, low)


def mask_low_qual(calls: DataFrame, min_qual: float = 30) -> DataFrame:
    """Masks records with an ALT and a low QUAL; 0 switches it off."""
    return _masked(calls, (F.size("alt") > 0) & (F.col("qual") < min_qual)) if min_qual else calls


def is_indel(ref: Column, alt: Column) -> Column:
    return F.exists(alt, lambda a: (a != "*") & (F.length(a) != F.length(ref)))


def tag_near_indel(calls: DataFrame, gap: int = 5, by: tuple[str, ...] = ("sample", "chrom")) -> DataFrame:
    """calls with near_indel: an ALT-bearing record without indel, within gap of an indel's bases.

    One scan and one shuffle: in order of place a running maximum tells how far the indels before a
    record reach, and a frame of gap places whether one begins after it. Windows by (sample, chrom, pos) that
    follow, as in drop_multi_record, need no further shuffle.
    """
    if not gap:
        return calls.withColumn("near_indel", F.lit(False))
    indel = F.coalesce(is_indel(F.col("ref"), F.col("alt")), F.lit(False))
    reach = F.when(F.col("_indel"), F.col("pos") + F.length("ref") - 1 + gap)
    place = Window.partitionBy(*by).orderBy("pos")
    before = F.coalesce(F.max(reach).over(place.rangeBetween(Window.unboundedPreceding, 0)) >= F.col("pos"), F.lit(False))
    after = F.coalesce(F.max(F.col("_indel")).over(place.rangeBetween(0, gap)), F.lit(False))
    rows = calls.withColumn("_indel", indel).withColumns({"_before": before, "_after": after})
    near = (F.size("alt") > 0) & ~F.col("_indel") & (F.col("_before") | F.col("_after"))
    return rows.withColumn("near_indel", near).select(*calls.columns, "near_indel")


def mask_snp_gap(calls: DataFrame, gap: int = 5) -> DataFrame:
    """Masks records near an indel and adds SnpGap to their filter tags."""
    tagged = tag_near_indel(calls, gap)
    tags = F.when(F.col("near_indel"), F.array_union("filter", F.array(F.lit("SnpGap")))).otherwise(F.col("filter"))
    return _masked(tagged.withColumn("filter", tags), F.col("near_indel")).drop("near_indel")


def split_multiallelic(calls: DataFrame) -> DataFrame:
    """One row per ALT: its allele number becomes 1, others 0, ao is its own; records without ALT stay."""
    alts = F.when(F.size("alt") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("alt"))
    rest = [c for c in calls.columns if c not in ("alt", "gt", "ao")]
    rows = calls.select(*rest, F.col("gt").alias("_gt"), F.col("ao").alias("_ao"), F.posexplode(alts).alias("_i", "_alt"))
    own = F.transform("_gt", lambda a: F.when(a.isNull(), None).when(a == F.col("_i") + 1, 1).otherwise(0))
    return rows.withColumns({
        "alt": F.when(F.col("_alt").isNull(), F.array().cast("array<string>")).otherwise(F.array("_alt")),
        "gt": own,
        "ao": F.when(F.col("_alt").isNull(), F.col("_ao")).otherwise(F.array(F.get("_ao", F.col("_i")))),
    }).select(*calls.columns)


def atomize(calls: DataFrame) -> DataFrame:
    """One row per differing base of one-ALT records of several bases, and one for their indel if REF and ALT are of unequal length.

    Alleles are aligned at their ends: of unequal ones what they share at the right goes first, so the
    indel lies as far left in them as it can; then bases are compared from the left, and the indel
    stands with the last REF base before it, which is a row of its own if it differs. Records of one base, of no or several
    ALTs, and of symbols (``*``, ``<DEL>``) stay.
    """
    alt = F.get("alt", F.lit(0))
    several = (F.size("alt") == 1) & (F.greatest(F.length("ref"), F.length(alt)) > 1) & alt.rlike("^[A-Za-z]+$")
    rows = calls.withColumns({"_alt": alt, "_short": F.when(several, F.least(F.length("ref"), F.length(alt)))})
    at = lambda x, i: F.substr(x, i, F.lit(1))
    back = lambda x, i: at(x, F.length(x) - i + 1)
    shared = F.aggregate(
        F.when(F.col("_short") > 1, F.sequence(F.lit(1), F.col("_short") - 1)).otherwise(F.array().cast("array<int>")), F.lit(0),
        lambda k, i: F.when((k == i - 1) & (back(F.col("ref"), i) == back(F.col("_alt"), i)), i).otherwise(k),
    )
    rows = rows.withColumn("_cut", F.when(F.length("ref") == F.length("_alt"), 0).otherwise(shared))
    m, rest = F.col("_short") - F.col("_cut"), lambda x: F.substr(x, F.col("_short") - F.col("_cut") + 1, F.length(x) - F.col("_short"))
    bases = F.filter(F.sequence(F.lit(1), m), lambda i: at(F.col("ref"), i) != at(F.col("_alt"), i))
    atom = lambda i, r, a: F.struct(i.cast("int").alias("i"), r.alias("ref"), F.array(a).alias("alt"))
    single = F.transform(bases, lambda i: atom(i - 1, at(F.col("ref"), i), at(F.col("_alt"), i)))
    indel = F.array(atom(m - 1, F.concat(at(F.col("ref"), m), rest(F.col("ref"))), F.concat(at(F.col("ref"), m), rest(F.col("_alt")))))
    atoms = F.when(F.length("ref") == F.length("_alt"), single).otherwise(F.concat(single, indel))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.col("ref").alias("ref"), F.col("alt").alias("alt")))
    rows = rows.withColumn("_atom", F.explode(F.when(F.col("_short").isNotNull(), atoms).otherwise(whole)))
    parts = {"pos": F.col("pos") + F.col("_atom.i"), "ref": F.col("_atom.ref"), "alt": F.col("_atom.alt")}
    return rows.select(*[parts.get(c, F.col(c)).alias(c) for c in calls.columns])


def drop_indels(calls: DataFrame) -> DataFrame:
    return calls.filter(~is_indel(F.col("ref"), F.col("alt")))


def with_ab_status(calls: DataFrame, low: float = 0.25, high: float = 0.75, tolerance: int = 2) -> DataFrame:
    """calls with status (null unless het) and ab, from the first number of ao."""
    ao = F.get(F.filter("ao", lambda x: x.isNotNull()), F.lit(0))
    het = genotype_code(F.col("gt")) == "het"
    status = F.when(het, F.coalesce(ab_status(ao, F.col("ro"), F.col("dp"), low, high, tolerance), F.lit("exempt")))
    ab = F.when(status.isin("kept", "blanked"), F.try_divide(ao.cast("double"), ao + F.col("ro")))
    return calls.withColumns({"status": status, "ab": ab})


def mask_allele_balance(calls: DataFrame, low: float = 0.25, high: float = 0.75, tolerance: int = 2) -> DataFrame:
    if low <= 0 and high >= 1:
        return calls
    rows = with_ab_status(calls, low, high, tolerance)
    return _masked(rows, F.col("status") == "blanked").drop("status", "ab")


def drop_multi_record(calls: DataFrame) -> DataFrame:
    """calls without any record of positions that have several."""
    w = Window.partitionBy("sample", "chrom", "pos")
    return calls.withColumn("_n", F.count("*").over(w)).filter("_n = 1").drop("_n")


def merge_records(calls: DataFrame) -> DataFrame:
    """One row per sample and position: records joined, their ALT lists made one, allele numbers following it.

    Records count in order of REF, ALT and their other fields, equal ones once. REF is the longest; ALTs of
    shorter ones get what they lack. Each place of the genotype has the first ALT that a record
    has there, else REF if one calls it, else it is missing. ao follows the ALTs; dp, gq, qual and ro are the
    first record's; filter has the tags of all.
    """
    order = ["ref", "_alts", "dp", "gq", "qual", "ro", "alt", "gt", "ao", "filter"]
    keyed = calls.withColumn("_alts", F.array_join("alt", ",")).select("sample", "chrom", "pos", F.struct(*order).alias("r"))
    rows = keyed.groupBy("sample", "chrom", "pos").agg(F.sort_array(F.collect_set("r")).alias("rs"))
    longest = F.aggregate("rs", F.lit(""), lambda a, r: F.when(F.length(r["ref"]) > F.length(a), r["ref"]).otherwise(a))
    rows = rows.withColumn("ref", longest)
    own_alts = lambda r: F.transform(r["alt"], lambda x: F.when(x == "*", x).otherwise(F.concat(x, F.substr(F.col("ref"), F.length(r["ref"]) + 1, F.length("ref")))))
    rows = rows.withColumn("rs", F.transform("rs", lambda r: r.withField("alt", own_alts(r))))
    rows = rows.withColumn("alt", F.array_distinct(F.flatten(F.transform("rs", lambda r: r["alt"]))))
    ploidy = F.array_max(F.transform("rs", lambda r: F.coalesce(F.size(r["gt"]), F.lit(0))))

    def allele(i: Column) -> Column:
        found = F.transform("rs", lambda r: F.when(F.get(r["gt"], i) == 0, F.lit("")).otherwise(F.get(r["alt"], F.get(r["gt"], i) - 1)))
        first = F.get(F.filter(found, lambda x: x.isNotNull() & (x != "")), F.lit(0))
        ref = F.coalesce(F.exists(found, lambda x: x == ""), F.lit(False))
        return F.when(first.isNotNull(), F.array_position(F.col("alt"), first).cast("int")).when(ref, 0)

    gt = F.when(ploidy > 0, F.transform(F.sequence(F.lit(0), ploidy - 1), allele))
    of = lambda x: F.get(F.filter(F.transform("rs", lambda r: F.get(r["ao"], (F.array_position(r["alt"], x) - 1).cast("int"))), lambda y: y.isNotNull()), F.lit(0))
    first = F.col("rs")[0]
    fields = {
        "gt": gt, "ao": F.when(F.size("alt") > 0, F.transform("alt", of)).otherwise(first["ao"]),
        "filter": F.array_distinct(F.flatten(F.transform("rs", lambda r: r["filter"]))), **{c: first[c] for c in ("qual", "dp", "gq", "ro")},
    }
    return rows.withColumns(fields).select("sample", "chrom", "pos", "ref", "alt", "qual", "filter", "gt", "dp", "gq", "ro", "ao")


def filter_chain(
    calls: DataFrame, min_dp: int = 5, min_gq: float = 20, min_qual: float = 30, snp_gap: int = 5,
    low: float = 0.25, high: float = 0.75, tolerance: int = 2, drop_multi: bool = True,
) -> DataFrame:
    """The whole chain: blocks, masks, allele split, indels, allele balance; positions with several records go or are merged."""
    calls = mask_low_qual(mask_low_gt(split_blocks(calls), min_dp, min_gq), min_qual)
    calls = drop_indels(atomize(split_multiallelic(mask_snp_gap(calls, snp_gap))))
    calls = mask_allele_balance(calls, low, high, tolerance)
    return drop_multi_record(calls) if drop_multi else merge_records(calls)


def with_code(calls: DataFrame) -> DataFrame:
    return calls.withColumn("code", genotype_code(F.col("gt")))


def genotype_summary(calls: DataFrame) -> DataFrame:
    """Per sample: records, those with an ALT allele, het, ref and missing, with percentages of the records."""
    n = {c: F.count_if(F.col("code") == c).alias(f"n_{c}") for c in ("alt", "het", "ref", "miss")}
    rows = calls.groupBy("sample").agg(F.count("*").alias("n_records"), *n.values())
    return rows.select("*", *[percent(F.col(f"n_{c}"), F.col("n_records")).alias(f"pct_{c}") for c in n])


def run_counters(raw: DataFrame, filtered: DataFrame) -> DataFrame:
    """Per sample: block records and records before the chain, records after it, and those tagged SnpGap."""
    block = (F.size("alt") == 0) & (F.length("ref") > 1)
    before = raw.groupBy("sample").agg(F.count("*").alias("n_raw"), F.count_if(block).alias("n_blocks"))
    after = filtered.groupBy("sample").agg(F.count("*").alias("n_filtered"), F.count_if(F.array_contains("filter", "SnpGap")).alias("n_snp_gap"))
    rows = before.join(after, "sample", "left").fillna(0, ["n_filtered", "n_snp_gap"])
    return rows.withColumn("n_removed", F.col("n_raw") - F.col("n_filtered"))
