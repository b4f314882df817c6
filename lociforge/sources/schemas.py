"""Explicit schemas of all inputs; nothing is inferred."""

from __future__ import annotations

#: DDL strings, as spark.read.schema() takes them.
LOCI = "chrom string, start long, end long, locus string"
CALLS_RAW = (
    "sample string, chrom string, pos long, ref string, alt array<string>, qual double, filter array<string>, "
    "gt array<int>, dp int, gq double, ro int, ao array<int>"
)
HITS = (
    "query string, subject string, pident double, length long, evalue double, bitscore double, qlen long, slen long, "
    "qstart long, qend long, sstart long, send long, qcov double, qcovhsp double, mismatch long, gaps long, title string, taxids string"
)
SITES = "chrom string, pos long, locus string, code string"
COUNTS = "locus string, n_het int, n_alt int, n_ref int, n_miss int, mean_dp double, n_dp int"
HET_AB = "chrom string, pos long, locus string, dp double, ro double, ao string, ab double, status string"
WINDOWS = "chrom string, start long, end long, depth double"
META = "sample string, species string, locality string, city string, state string, contam boolean, land_type string"
