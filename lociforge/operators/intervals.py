"""Positions and intervals. Intervals are 0-based and half-open, positions 1-based.

Joins meet in bins. An interval goes by its length to a level, whose bins are at least as wide,
so it lies in two of them at most whatever its length; the other side looks into the bins of each level there
is. Bins that hold far more than others are told from their counts and split: one side is dealt over the
parts, the other copied to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociforge.operators.stored import stored

#: Intervals up to which a join broadcasts them.
MAX_BROADCAST = 100_000
#: Bins of a level are so many times as wide as those of the one below.
STEP = 8
#: Rows of a bin from which it is split, and a share of all rows: so few bins are split that their list can be broadcast.
HOT, HOT_SHARE = 1_000_000, 1 / 10_000


def _level(length: Column, bin: int) -> Column:
    """The number of the first level whose bins are as wide as length."""
    return F.greatest(F.ceil(F.log(F.greatest(length, F.lit(1)) / bin) / F.log(F.lit(float(STEP))) - 1e-9), F.lit(0)).cast("int")


def _width(level: Column, bin: int) -> Column:
    return F.lit(bin) * F.pow(F.lit(STEP), level).cast("bigint")


def _levels(df: DataFrame, bin: int) -> tuple[list[int], int]:
    """The levels of the intervals in df and how many intervals there are: one row a level."""
    rows = df.groupBy(_level(F.col("end") - F.col("start"), bin).alias("level")).count().collect()
    return sorted(r["level"] for r in rows), sum(r["count"] for r in rows)


def _binned(df: DataFrame, start: Column, end: Column, others: list[int], bin: int, first: bool) -> DataFrame:
    """df with the bins in which it meets intervals of the levels of others: _a and _b, the levels of the left and the right side, and _bin."""
    own = _level(end - start, bin)
    pairs = F.explode(F.array(*[F.lit(x) for x in others]).cast("array<int>"))
    rows = df.withColumns({"_own": own, "_other": pairs})
    width = _width(F.greatest("_own", "_other"), bin)
    bins = F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))
    return rows.withColumn("_bin", bins).withColumnsRenamed({"_own": "_a", "_other": "_b"} if first else {"_own": "_b", "_other": "_a"})


_KEYS = ["chrom", "_a", "_b", "_bin"]


def _met(left: DataFrame, right: DataFrame, few: bool, hot: int = HOT) -> DataFrame:
    """left and right, both binned, joined on their bins; right is broadcast if few."""
    if few:
        return left.join(F.broadcast(right), _KEYS)
    counts = stored(left.groupBy(*_KEYS).agg(F.count("*").alias("_n")), "bins")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    most = max(hot, int(total * HOT_SHARE))
    split = counts.filter(F.col("_n") > most).select(*_KEYS, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    left = left.join(F.broadcast(split), _KEYS, "left")  # total / most rows at most
    told = [F.col(f"`{c}`") for c, t in left.dtypes if "map<" not in t]  # a hash, so that a task that is run again deals alike
    left = left.withColumn("_part", F.pmod(F.xxhash64(*told), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = right.join(F.broadcast(split), _KEYS, "left")
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*_KEYS, "_part"]).drop("_part")


def within(pos: Column, start: Column, end: Column) -> Column:
    return (pos > start) & (pos <= end)


def assign_locus(points: DataFrame, loci: DataFrame, bin: int = 5000, every: bool = False, limit: int = MAX_BROADCAST, hot: int = HOT) -> DataFrame:
    """points (chrom, pos, ...) with the locus that holds each; points outside of all are dropped.

    Of several loci a point gets the one with the least (start, locus), or with every=True all.
    """
    loci = loci.select("chrom", "start", "end", "locus")
    if not every:
        # loci that overlap an earlier one give up their shared positions to it
        loci = _without_shadowed(loci)
    levels, n = _levels(loci, bin)
    left = _binned(points, F.col("pos") - 1, F.col("pos"), levels, bin, first=True)
    joined = _met(left, _binned(loci, F.col("start"), F.col("end"), [0], bin, first=False), n <= limit, hot)
    return joined.filter(within(F.col("pos"), F.col("start"), F.col("end"))).drop("_a", "_b", "_bin", "start", "end")


def _without_shadowed(loci: DataFrame) -> DataFrame:
    """loci with starts moved past the end of all earlier ones; those wholly inside are dropped."""
    w = Window.partitionBy("chrom").orderBy("start", "locus").rowsBetween(Window.unboundedPreceding, -1)
    moved = loci.withColumn("start", F.greatest("start", F.coalesce(F.max("end").over(w), F.col("start"))))
    return moved.filter("start < `end`")


def overlaps(a: DataFrame, b: DataFrame, bin: int = 100_000, limit: int = MAX_BROADCAST, hot: int = HOT) -> DataFrame:
    """Rows of a (chrom, start, end, ...) with those of b (chrom, start, end, ...) they overlap, and ``overlap`` in bases.

    b's columns but chrom get the prefix b_. A pair is given once, in the first bin it shares.
    """
    (left, _), (right, n) = _levels(a, bin), _levels(b, bin)
    b = b.select("chrom", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "chrom"])
    length = F.least("end", "b_end") - F.greatest("start", "b_start")
    a = _binned(a, F.col("start"), F.col("end"), right, bin, first=True)
    joined = _met(a, _binned(b, F.col("b_start"), F.col("b_end"), left, bin, first=False), n <= limit, hot).filter(length > 0)
    once = F.col("_bin") == F.floor(F.greatest("start", "b_start") / _width(F.greatest("_a", "_b"), bin))
    return joined.filter(once).withColumn("overlap", length).drop("_a", "_b", "_bin")


def count_overlaps(loci: DataFrame, points: DataFrame) -> DataFrame:
    """(locus, n_points) for every locus, zeros kept."""
    found = assign_locus(points, loci, every=True).groupBy("locus").agg(F.count("*").alias("n_points"))
    return loci.select("locus").join(found, "locus", "left").fillna(0, ["n_points"])


def restrict_to(points: DataFrame, loci: DataFrame) -> DataFrame:
    """points that lie in any of loci."""
    return assign_locus(points.drop("locus"), loci).drop("locus") if "locus" not in points.columns else points.join(
        loci.select("locus").distinct(), "locus", "left_semi"
    )


def hits_to_bed(hits: DataFrame) -> DataFrame:
    """(chrom, start, end, locus) of hits (query, subject, sstart, send), on either strand, by place."""
    return hits.select(
        F.col("subject").alias("chrom"),
        (F.least("sstart", "send") - 1).alias("start"), F.greatest("sstart", "send").alias("end"),
        F.col("query").alias("locus"),
    ).orderBy("chrom", "start", "locus")


def buffered(bed: DataFrame, n: int) -> DataFrame:
    """Intervals with n more bases on each side, their starts not below 0."""
    if n < 0:
        raise ValueError("the buffer must not be negative")
    return bed.withColumn("start", F.greatest(F.col("start") - n, F.lit(0))).withColumn("end", F.col("end") + n)


def n_overlapping(bed: DataFrame) -> DataFrame:
    """One row: how many intervals begin before an earlier one of their chromosome ends."""
    w = Window.partitionBy("chrom").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return bed.withColumn("_end", F.max("end").over(w)).agg(F.count_if(F.col("start") < F.col("_end")).alias("n_overlapping"))


def assert_disjoint(bed: DataFrame) -> DataFrame:
    n = n_overlapping(bed).first()[0]
    if n:
        raise ValueError(f"{n} intervals overlap an earlier one")
    return bed
