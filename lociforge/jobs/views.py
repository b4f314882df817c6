"""Genotype-like views of the sales tables, for runs and checks without sequencing data.

A supplier is a sample, a part number modulo 40 a locus; the k-th line of a supplier and locus
is a call at its k-th position, so every line is a record. Quantities give the genotype. Loci
36-39 play the sex chromosome; every third sample has half depth there. Before the filter
chain some records are deletions, blocks, changes of several bases or of bases and length, records with two
alleles, or come twice. Every order is a coverage window, every part a target.

The expressions are SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE = {
    "s": "l_suppkey",
    "loc": "cast(l_partkey % 40 as int)",
    "q": "cast(l_quantity as int)",
    "d": "cast(round(l_discount * 100) as int)",
    "t": "cast(round(l_tax * 100) as int)",
    "c": "cast(round(l_extendedprice * 100) as bigint)",
}
#: Order of the lines of a supplier and locus; rows that are alike in all of these are alike in the view.
LINES = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
CODE = (
    "case when q <= 4 then 'miss' when loc % 10 = 0 and off % 3 = 0 and q <= 42 then 'het' when loc = 39 and s % 3 = 0 and off <= 4 then 'het' "
    "when loc >= 36 and s % 3 = 0 then 'ref' when q <= 12 then 'het' when q <= 16 then 'alt' else 'ref' end"
)
CHROM = "case when loc >= 36 then 'chrZ' else 'chr' || cast(loc % 4 as string) end"
CALLS = {
    "sample": "s",
    "chrom": CHROM,
    "pos": "cast(loc * 1000 + off as bigint)",
    "locus": "loc",
    "code": CODE,
    "dp": "cast(case when loc >= 36 and s % 3 = 0 then 10 else 20 end + c % 15 as int)",
    "ref": "substr('ACGT', (loc * 7 + off * 3) % 4 + 1, 1)",
    "alt": "substr('ACGT', ((loc * 7 + off * 3) % 4 + 1 + off % 3) % 4 + 1, 1)",
    "alt2": "substr('ACGT', ((loc * 7 + off * 3) % 4 + 1 + (off + 1) % 3) % 4 + 1, 1)",
    "raw_dp": "cast(2 + c % 40 as int)",
    "gq": "cast(12 + (c + q) % 50 as int)",
    "qual": "cast(20 + c % 200 as int)",
    "is_indel": "c % 53 = 0",
    "kind": "case when c % 53 = 0 then 'indel' when c % 17 = 3 then 'block' when c % 19 = 4 then 'mnv' when c % 23 = 5 then 'two' when c % 29 = 6 then 'twice' when c % 31 = 7 then 'complex' else 'plain' end",
    "w": "case when loc % 10 = 5 then 2 + d % 4 else 2 + d end",
    "t": "t",
}
ALLELES = {"ao": "cast((raw_dp * w - (raw_dp * w) % 14) / 14 as int)"}
LOCI = {"chrom": CHROM, "start": "cast(loc * 1000 as bigint)", "end": "cast(loc * 1000 + n as bigint)", "locus": "loc"}
META = {
    "sample": "s_suppkey", "species": "r_name", "state": "n_name", "contam": "s_suppkey % 10 = 0",
    "seq_batch": "cast(s_suppkey % 2 as int)", "land_type": "cast(s_nationkey % 2 as int)",
}
HITS = {
    "query": "l_partkey", "subject": "l_suppkey", "pident": "80 + cast(l_quantity as int) % 21", "evalue": "cast(round(l_tax * 100) as int)",
    "bitscore": "l_extendedprice", "qcov": "70 + 3 * cast(round(l_discount * 100) as int)", "o": "l_orderkey", "line": "l_linenumber",
    "sstart": "case when l_linenumber % 2 = 1 then l_orderkey + cast(l_quantity as int) else l_orderkey end",
    "send": "case when l_linenumber % 2 = 1 then l_orderkey else l_orderkey + cast(l_quantity as int) end",
}
WINDOWS = {
    "sample": "cast(o_custkey % 50 as int)", "chrom": "'chr1'", "start": "o_orderkey * 50", "end": "o_orderkey * 50 + 50",
    "depth": "cast(round(o_totalprice * 100) as bigint) % 60",
}
TARGETS = {"chrom": "'chr1'", "start": "p_partkey * 120", "end": "p_partkey * 120 + 70", "locus": "p_partkey"}
MAPPING = {
    "sample": "l_suppkey", "n_reads": "cast(sum(l_quantity) as bigint)", "n_mapped": "cast(sum(case when l_returnflag <> 'R' then l_quantity else 0 end) as bigint)",
    "n_paired": "cast(sum(case when l_linestatus = 'O' then l_quantity else 0 end) as bigint)", "n_mq0": "cast(sum(case when l_discount < 0.005 then l_quantity else 0 end) as bigint)",
    "n_duplicate": "cast(sum(case when l_linenumber = 1 then l_quantity else 0 end) as bigint)",
}
HIT_TIES = ("subject", "o", "line", "sstart")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as(columns: dict[str, str]) -> list[str]:
    return [f"{x} as `{c}`" for c, x in columns.items()]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line of the table: sample, place, code, depth, alleles, kind of the raw record."""
    off = F.row_number().over(Window.partitionBy("s", "loc").orderBy(*LINES))
    rows = _table(spark, sf_dir, "lineitem").selectExpr(*_as(BASE), *LINES).withColumn("off", off)
    return rows.selectExpr(*_as(CALLS)).selectExpr("*", *_as(ALLELES)).selectExpr("*", "greatest(raw_dp - ao - t % 5, 0) as ro").drop("w", "t")


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls before the filter chain, by kind.

    indel: a deletion of one base; block: three bases without ALT, ref or missing; mnv: three bases of which the
    first and last change; complex: four bases of which the first two change and the third is deleted; two: two ALTs, a genotype of both unless it is missing; twice: the record
    again with one more read. Others have an ALT where it is called.
    """
    rows = calls(spark, sf_dir)
    none = F.lit(None).cast("array<int>")
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    miss = F.col("code") == "miss"
    gt = (
        F.when(miss, none).when(is_("block"), F.array(F.lit(0), F.lit(0))).when(is_("two"), F.array(F.lit(1), F.lit(2)))
        .when(F.col("code") == "het", F.array(F.lit(0), F.lit(1))).when(F.col("code") == "alt", F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(0)))
    )
    ref = F.when(is_("indel"), F.concat("ref", F.lit("A"))).when(is_("block"), F.concat("ref", F.lit("CG"))).when(is_("mnv"), F.concat("ref", F.lit("CT"))).when(is_("complex"), F.concat("ref", F.lit("CTA"))).otherwise(F.col("ref"))
    alt = (
        F.when(is_("indel"), F.array("ref")).when(is_("block"), F.array().cast("array<string>")).when(is_("mnv"), F.array(F.concat("alt", F.lit("CA")))).when(is_("complex"), F.array(F.concat("alt", F.lit("GA"))))
        .when(is_("two"), F.array("alt", "alt2")).when(F.col("code").isin("het", "alt"), F.array("alt")).otherwise(F.array().cast("array<string>"))
    )
    ao = F.when(is_("two"), F.array(F.col("ao"), F.col("ro"))).otherwise(F.array("ao"))
    again = F.explode(F.when(is_("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again")
    rows = rows.select("*", again)
    return rows.select(
        "sample", "chrom", "pos", "locus", ref.alias("ref"), alt.alias("alt"), F.col("qual").cast("double").alias("qual"),
        F.array().cast("array<string>").alias("filter"), gt.alias("gt"), (F.col("raw_dp") + F.col("_again")).alias("dp"),
        F.col("gq").cast("double").alias("gq"), "ro", ao.alias("ao"),
    )


def het_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heterozygotes with their raw allele counts."""
    return calls(spark, sf_dir).filter("code = 'het'").select("sample", "chrom", "pos", "locus", F.col("raw_dp").alias("dp"), "ro", "ao")


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each locus is as long as the greatest number of its lines that a supplier has."""
    lines = _table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "cast(l_partkey % 40 as int) as loc").groupBy("loc", "l_suppkey").count()
    return lines.groupBy("loc").agg(F.max("count").alias("n")).selectExpr(*_as(LOCI))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(*_as(META))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(*_as(HITS))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each sample: all, mapped, in pairs, of mapping quality 0, duplicates."""
    return _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[F.expr(x).alias(c) for c, x in MAPPING.items() if c != "sample"]).withColumnRenamed("l_suppkey", "sample")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(*_as(WINDOWS))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr(*_as(TARGETS))


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f'{x} as "{c}"' for c, x in columns.items())


#: The same views as SQL of a WITH clause.
SQL = f"""
base as (select *, row_number() over (partition by s, loc order by {", ".join(LINES)}) as off from (select {_sql(BASE)}, {", ".join(LINES)} from lineitem)),
calls as (select *, greatest(raw_dp - ao - t % 5, 0) as ro from (select *, {_sql(ALLELES)} from (select {_sql(CALLS)} from base))),
loci as (select {_sql(LOCI)}, n::bigint as len from (select loc, max(k) as n from (select l_suppkey, cast(l_partkey % 40 as int) as loc, count(*) as k from lineitem group by all) group by loc)),
samples as (select s_suppkey as sample from supplier),
size as (select count(*) as n from samples),
meta as (select {_sql(META)} from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
hits as (select {_sql(HITS)} from lineitem),
mapping as (select {_sql(MAPPING)} from lineitem group by l_suppkey),
windows as (select {_sql(WINDOWS)} from orders),
targets as (select {_sql(TARGETS)} from part)
"""
