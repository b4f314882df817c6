"""Alignment hits: (query, subject, pident, evalue, bitscore, qcov, sstart, send, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_hits(hits: DataFrame, pct_id: float | None = None, pct_qcov: float | None = None, qcov: str = "qcov") -> DataFrame:
    if pct_id is not None:
        hits = hits.filter(F.col("pident") >= pct_id)
    return hits if pct_qcov is None else hits.filter(F.col(qcov) >= pct_qcov)


def filter_any_hit(hits: DataFrame, pct_id: float = 95, pct_qcov: float = 90, qcov: str = "qcov") -> DataFrame:
    """Hits of queries of which any hit reaches pct_id and any, maybe another, pct_qcov."""
    w = Window.partitionBy("query")
    hits = hits.withColumns({"_id": F.max("pident").over(w), "_cov": F.max(qcov).over(w)})
    return hits.filter((F.col("_id") >= pct_id) & (F.col("_cov") >= pct_qcov)).drop("_id", "_cov")


def single_hit_queries(hits: DataFrame) -> DataFrame:
    """(query) of those with one hit."""
    return hits.groupBy("query").agg(F.count("*").alias("n")).filter("n = 1").select("query")


def drop_multi_hits(hits: DataFrame, counted_on: DataFrame | None = None) -> DataFrame:
    """Hits of queries that have one hit in ``counted_on``, by default hits itself."""
    return hits.join(single_hit_queries(hits if counted_on is None else counted_on), "query", "left_semi")


def best_first(*ties: str) -> list[Column]:
    return [F.asc("evalue"), F.desc("bitscore"), F.desc("pident"), *[F.asc(c) for c in ties]]


def top_n_hits(hits: DataFrame, n: int | None, by: tuple[str, ...] = ("query",), ties: tuple[str, ...] = ("subject",)) -> DataFrame:
    """The n best hits of each group; none or 0 keeps all."""
    if not n:
        return hits
    w = Window.partitionBy(*by).orderBy(*best_first(*ties))
    return hits.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank") <= n)


def best_hit(hits: DataFrame, ties: tuple[str, ...] = ("subject",)) -> DataFrame:
    return top_n_hits(hits, 1, ties=ties).drop("hit_rank")


def hit_drops(hits: DataFrame, ties: tuple[str, ...] = ("subject",)) -> DataFrame:
    """hits with their query's count, and by how much identity and coverage fall to its next hit."""
    w = Window.partitionBy("query").orderBy(*best_first(*ties))
    return hits.withColumns({
        "n_hits": F.count("*").over(Window.partitionBy("query")),
        "id_drop": F.col("pident") - F.lead("pident").over(w),
        "qcov_drop": F.col("qcov") - F.lead("qcov").over(w),
    })


def hit_counts(hits: DataFrame) -> DataFrame:
    return hits.agg(
        F.count("*").alias("n_hits"), F.count_distinct("query").alias("n_queries"), F.count_distinct("subject").alias("n_subjects")
    )


def best_hit_counts(hits: DataFrame, pct_id: float = 95, pct_qcov: float = 90, ties: tuple[str, ...] = ("subject",)) -> DataFrame:
    """One row: queries with a hit, those whose best hit is low in identity or coverage, those with several."""
    best = top_n_hits(hits.withColumn("_n", F.count("*").over(Window.partitionBy("query"))), 1, ties=ties)
    return best.agg(
        F.count("*").alias("n_queries"), F.count_if(F.col("pident") < pct_id).alias("n_low_id"),
        F.count_if(F.col("qcov") < pct_qcov).alias("n_low_qcov"), F.count_if(F.col("_n") > 1).alias("n_multi"),
    )


def off_target(hits: DataFrame, near: int = 10_000, ties: tuple[str, ...] = ("subject",)) -> DataFrame:
    """(query, off_target): bitscore of the best hit elsewhere (another subject or farther than near) by that of the best hit."""
    best = best_hit(hits, ties).select("query", F.col("subject").alias("_s"), F.col("sstart").alias("_at"), F.col("bitscore").alias("_best"))
    away = (F.col("subject") != F.col("_s")) | (F.abs(F.col("sstart") - F.col("_at")) > near)
    rows = hits.join(best, "query").groupBy("query").agg(F.max(F.when(away, F.col("bitscore"))).alias("_away"), F.first("_best").alias("_best"))
    return rows.select("query", F.coalesce(F.try_divide("_away", "_best"), F.lit(0.0)).alias("off_target"))
