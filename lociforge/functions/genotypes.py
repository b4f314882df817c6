"""Column expressions on genotypes, bases and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes of two different bases, in alphabetical order.
IUPAC = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def genotype_code(gt: Column) -> Column:
    """miss, het, alt or ref, from an array of allele numbers (null: missing)."""
    missing = gt.isNull() | (F.size(gt) == 0) | F.exists(gt, lambda a: a.isNull())
    return (
        F.when(missing, "miss")
        .when(F.array_min(gt) != F.array_max(gt), "het")
        .when(F.element_at(gt, 1) > 0, "alt")
        .otherwise("ref")
    )


def iupac(a: Column, b: Column) -> Column:
    """The base of two equal ones, else their IUPAC code; N if either is not one of ACGT."""
    pair = F.concat(F.least(a, b), F.greatest(a, b))
    known = a.isin(*"ACGT") & b.isin(*"ACGT")
    out = F.when(known & (a == b), a)
    for bases, code in IUPAC.items():
        out = out.when(pair == bases, code)
    return F.coalesce(out, F.lit("N"))


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.least(ref, alt), F.greatest(ref, alt)).isin("AG", "CT")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b)


def percent(a: Column, b: Column) -> Column:
    return F.try_divide(100.0 * a, b)


def judged(ao: Column, ro: Column, dp: Column, tolerance: int) -> Column:
    """Whether allele counts add up to the depth closely enough to be judged."""
    return F.coalesce((ao + ro > 0) & (F.abs(ao + ro - dp) <= tolerance), F.lit(False))


def balance(ao: Column, ro: Column) -> Column:
    return ratio(ao, ao + ro)


def ab_status(ao: Column, ro: Column, dp: Column, low: float = 0.25, high: float = 0.75, tolerance: int = 2) -> Column:
    """Of a heterozygote: exempt if it can't be judged, else blanked outside of [low, high], else kept."""
    ab = balance(ao, ro)
    return F.when(~judged(ao, ro, dp, tolerance), "exempt").when((ab < low) | (ab > high), "blanked").otherwise("kept")


def first_number(values: Column) -> Column:
    """The first integer of a comma list such as ``6,.``; null if it has none."""
    return F.get(F.filter(F.split(values, ","), lambda x: x.rlike("^[0-9]+$")), F.lit(0)).cast("int")


def short_sample(name: Column) -> Column:
    """The text after the last underscore."""
    return F.substring_index(name, "_", -1)


def without_prefix(name: Column, prefix: str) -> Column:
    return F.when(F.startswith(name, F.lit(prefix)), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)


def safe_name(name: Column) -> Column:
    """A name that is safe as a file name."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def region_name(chrom: Column, start: Column, end: Column) -> Column:
    """chrom:first-last, both 1-based, of a half-open interval."""
    return F.concat(chrom, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string"))


def interval_of_region(name: Column) -> Column:
    """struct(chrom, start, end) of a name as region_name gives it; any other name fails."""
    return _interval(name, r"^(.+):([0-9]+)-([0-9]+)$")


def interval_of_locus(name: Column) -> Column:
    """struct(chrom, start, end) of a locus name that ends in _<chrom>_<first>-<last>, both 1-based, maybe with a file ending."""
    return _interval(F.regexp_replace(name, r"\.fa(sta)?$", ""), r"_([^_]+(?:_[0-9.]+)?)_([0-9]+)-([0-9]+)$")


def _interval(name: Column, pattern: str) -> Column:
    part = lambda k: F.regexp_extract(name, pattern, k)
    found = F.struct(part(1).alias("chrom"), (part(2).try_cast("bigint") - 1).alias("start"), part(3).try_cast("bigint").alias("end"))
    return F.when(name.rlike(pattern), found).otherwise(F.raise_error(F.concat(F.lit("no interval in the name "), name)))


def distance_bin(dist: Column, width: int) -> Column:
    """Lower bound of the bin of a signed distance to an edge; 1 and up inside, 0 and down outside."""
    inside = F.floor((dist - 1) / width) * width
    outside = -F.floor(-dist / width) * width - width
    return F.when(dist > 0, inside).otherwise(outside).cast("int")


def length_class(length: Column, below: int = 600) -> Column:
    return F.when(length < below, "short").otherwise("long")
