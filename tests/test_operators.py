"""Hand-made cases and brute force on small tables."""

import gzip
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lociforge.functions import genotypes as g
from lociforge.operators import calls as oc
from lociforge.operators import cohort, counts, hits, intervals, qc_tables, ranks, sequences, sex, sites
from lociforge.sources import hub, readers, schemas, writers
from lociforge.streaming.site_counts import count_arrivals

RAW = {"sample": "s1", "chrom": "c", "pos": 1, "ref": "A", "alt": [], "qual": 50.0, "filter": [], "gt": [0, 0], "dp": 10, "gq": 40.0, "ro": 5, "ao": [5]}


def raw(spark, *rows):
    names = list(RAW)
    return spark.createDataFrame([tuple((RAW | r)[c] for c in names) for r in rows], schemas.CALLS_RAW)


def codes(df):
    return [r["code"] for r in oc.with_code(df).orderBy("pos", "ref").collect()]


def test_records_near_an_indel_are_masked(spark):
    df = raw(spark, {"pos": 10, "ref": "AT", "alt": ["A"], "gt": [0, 1]}, {"pos": 13, "alt": ["C"], "gt": [0, 1]}, {"pos": 19, "alt": ["C"], "gt": [0, 1]}, {"pos": 12})
    masked = oc.mask_snp_gap(df, 5).orderBy("pos").collect()
    assert [r["gt"] for r in masked] == [[0, 1], [0, 0], None, [0, 1]] and masked[2]["filter"] == ["SnpGap"]
    assert all(r["gt"] for r in oc.mask_snp_gap(df, 0).collect())


def test_blocks_become_bases(spark):
    rows = oc.split_blocks(raw(spark, {"pos": 5, "ref": "GAACAACT", "dp": 7})).orderBy("pos").collect()
    assert "".join(r["ref"] for r in rows) == "GAACAACT" and [r["pos"] for r in rows] == list(range(5, 13)) and {r["dp"] for r in rows} == {7}


def test_unknown_quality_masks_nothing(spark):
    assert codes(oc.mask_low_gt(raw(spark, {"gq": None}, {"pos": 2, "dp": 4}, {"pos": 3, "gq": 19.0}))) == ["ref", "miss", "miss"]
    assert codes(oc.mask_low_qual(raw(spark, {"qual": 0.0}, {"pos": 2, "qual": 0.0, "alt": ["C"]}))) == ["ref", "miss"]


def test_alleles_split_and_positions_with_two_records_go(spark):
    df = raw(spark, {"pos": 10, "ref": "CTATG", "alt": ["TTATA", "CTATA"], "gt": [1, 2], "ao": [6, 4]})
    split = oc.atomize(oc.split_multiallelic(df)).orderBy("pos", "gt").collect()
    assert [(r["pos"], r["ref"], r["alt"], r["gt"]) for r in split] == [(10, "C", ["T"], [1, 0]), (14, "G", ["A"], [0, 1]), (14, "G", ["A"], [1, 0])]
    assert [r["pos"] for r in oc.drop_multi_record(oc.atomize(oc.split_multiallelic(df))).collect()] == [10]
    assert {r["pos"]: r["alt"] for r in oc.merge_records(df.unionByName(df)).collect()} == {10: ["TTATA", "CTATA"]}


def merged(spark, *rows):
    (r,) = oc.merge_records(raw(spark, *rows)).collect()
    return r


def test_merged_records_have_their_alleles_renumbered(spark):
    a, b = {"alt": ["C"], "gt": [0, 0], "ao": [3], "dp": 9}, {"alt": ["G"], "gt": [1, 1], "ao": [7], "dp": 12, "filter": ["SnpGap"]}
    for rows in ((a, b), (b, a)):
        r = merged(spark, *rows)
        assert (r["alt"], r["gt"], r["ao"], r["dp"], r["filter"], r["qual"], r["ro"]) == (["C", "G"], [2, 2], [3, 7], 9, ["SnpGap"], 50.0, 5)
    split = oc.atomize(oc.split_multiallelic(raw(spark, {"pos": 10, "alt": ["C", "G"], "gt": [1, 2]})))
    (r,) = oc.merge_records(split).collect()
    assert (r["alt"], r["gt"]) == (["C", "G"], [1, 2])
    missing = {"alt": ["C"], "gt": [None, None]}
    assert merged(spark, missing)["gt"] == [None, None] and merged(spark, missing | {"gt": None})["gt"] is None
    assert merged(spark, missing, {"alt": ["G"], "gt": [0, 1]})["gt"] == [0, 2]
    long = merged(spark, {"alt": ["C"], "gt": [0, 1]}, {"ref": "AT", "alt": ["A", "*"], "gt": [0, 1]})
    assert (long["ref"], long["alt"], long["gt"]) == ("AT", ["CT", "A", "*"], [0, 1])
    assert oc.filter_chain(raw(spark, {"alt": ["C", "G"], "gt": [1, 2], "gq": 60.0}), drop_multi=False).count() == 1


def test_balance_is_judged_within_the_tolerance(spark):
    base = {"alt": ["C"], "gt": [0, 1], "dp": 20}
    df = raw(spark, base | {"ro": 16, "ao": [2]}, base | {"pos": 2, "ro": 15, "ao": [2]}, base | {"pos": 3, "ro": 10, "ao": [None, 10]}, base | {"pos": 4, "ro": 0, "ao": [0], "dp": 0})
    assert [r["status"] for r in oc.with_ab_status(df).orderBy("pos").collect()] == ["blanked", "exempt", "kept", "exempt"]
    assert codes(oc.mask_allele_balance(df)) == ["miss", "het", "het", "het"]
    assert codes(oc.mask_allele_balance(df, 0, 1)) == ["het"] * 4


def test_codes_and_bases(spark):
    gts = [None, [], [None, 1], [0, 0], [0, 1], [1, 1], [1], [1, 2]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(gts)], "i int, gt array<int>")
    assert [r[0] for r in df.orderBy("i").select(g.genotype_code(F.col("gt"))).collect()] == ["miss", "miss", "miss", "ref", "het", "alt", "alt", "het"]
    row = spark.range(1).select(g.iupac(F.lit("G"), F.lit("A")), g.iupac(F.lit("C"), F.lit("C")), g.iupac(F.lit("A"), F.lit("*")), g.first_number(F.lit("6,.")), g.short_sample(F.lit("a_b_c"))).first()
    assert list(row) == ["R", "C", "N", 6, "c"]
    bins = spark.createDataFrame([(d,) for d in (-50, -1, 0, 1, 50, 51)], "d int").select(g.distance_bin(F.col("d"), 50)).collect()
    assert [r[0] for r in bins] == [-100, -50, -50, 0, 0, 50]


@pytest.fixture(scope="module")
def beds(spark):
    rng = random.Random(1)
    loci, at = [], 0
    for k in range(60):
        at += rng.randint(1, 90)
        loci.append((f"c{k % 2}", at, at + rng.randint(1, 120), f"l{k}"))
    points = [(f"c{rng.randint(0, 2)}", rng.randint(1, at)) for _ in range(400)]
    spans = [(f"c{rng.randint(0, 1)}", a := rng.randint(0, at), a + rng.randint(1, 60), float(k)) for k in range(150)]
    return loci, points, spans


@pytest.mark.parametrize("limit", [0, 1000])
def test_points_and_spans_against_brute_force(spark, beds, limit):
    loci, points, spans = beds
    bed, at = spark.createDataFrame(loci, schemas.LOCI), spark.createDataFrame(points, "chrom string, pos long")
    found = intervals.assign_locus(at, bed, bin=50, every=True, limit=limit).collect()
    assert sorted((r["chrom"], r["pos"], r["locus"]) for r in found) == sorted((c, p, n) for c, p in points for d, s, e, n in loci if c == d and s < p <= e)
    first = {(c, p): min(((s, n) for d, s, e, n in loci if c == d and s < p <= e), default=None) for c, p in points}
    one = intervals.assign_locus(at, bed, bin=50, limit=limit).collect()
    assert {(r["chrom"], r["pos"]): r["locus"] for r in one} == {k: v[1] for k, v in first.items() if v}
    wide = intervals.overlaps(spark.createDataFrame(spans, schemas.WINDOWS), bed, bin=40, limit=limit).collect()
    expected = sorted((k, n, min(b, e) - max(a, s)) for c, a, b, k in spans for d, s, e, n in loci if c == d and min(b, e) > max(a, s))
    assert sorted((r["depth"], r["b_locus"], r["overlap"]) for r in wide) == expected


def test_beds(spark):
    df = spark.createDataFrame([("q", "c", 500, 300), ("r", "c", 101, 200)], "query string, subject string, sstart long, send long")
    bed = intervals.hits_to_bed(df)
    assert [tuple(r) for r in bed.collect()] == [("c", 100, 200, "r"), ("c", 299, 500, "q")]
    assert [r["start"] for r in intervals.buffered(bed, 300).orderBy("locus").collect()] == [0, 0]
    with pytest.raises(ValueError):
        intervals.buffered(bed, -1)
    assert intervals.assert_disjoint(bed).count() == 2
    with pytest.raises(ValueError):
        intervals.assert_disjoint(intervals.buffered(bed, 300))


def test_hits_of_a_query_that_pass_by_two(spark):
    df = spark.createDataFrame([("q", "a", 96.0, 80.0), ("q", "b", 91.0, 95.0), ("r", "a", 94.0, 99.0)], "query string, subject string, pident double, qcov double")
    assert {r["query"] for r in hits.filter_any_hit(df).collect()} == {"q"}
    assert hits.drop_multi_hits(hits.filter_any_hit(df), df).count() == 0 and hits.top_n_hits(df, 0).count() == 3


CALLS = "sample string, chrom string, pos long, locus string, code string, dp int"


def test_counts_add_up_and_sparse_equals_dense(spark):
    loci = spark.createDataFrame([("c", 0, 4, "l"), ("c", 10, 12, "m")], schemas.LOCI)
    samples = spark.createDataFrame([("a",), ("b",)], "sample string")
    calls = spark.createDataFrame([("a", "c", 1, "l", "het", 9), ("a", "c", 2, "l", "ref", None), ("a", "c", 3, "l", "miss", 4)], CALLS)
    rows = counts.counts_per_locus(calls, loci, samples).collect()
    assert len(rows) == 4 and all(r["n_het"] + r["n_alt"] + r["n_ref"] + r["n_miss"] == (4 if r["locus"] == "l" else 2) for r in rows)
    a = next(r for r in rows if (r["sample"], r["locus"]) == ("a", "l"))
    assert (a["n_het"], a["n_ref"], a["n_miss"], a["mean_dp"], a["n_dp"]) == (1, 1, 2, 9.0, 1)
    sparse = counts.fill_missing_positions(calls, loci, samples)
    assert sparse.filter("code = 'miss'").count() == sum(r["n_miss"] for r in rows)
    dense = cohort.excess_het_loci(calls, loci, 2, min_call_frac=0.5).orderBy("locus").collect()
    full = cohort.excess_het_loci(sparse.withColumn("dp", F.lit(1)).unionByName(calls.filter("code = 'ref'")), loci, 2, min_call_frac=0.5).orderBy("locus").collect()
    assert dense == full and dense[0]["n_excess"] == 1


def test_consensus_trim_and_missingness(spark):
    loci = spark.createDataFrame([("c", 0, 4, "l")], schemas.LOCI)
    samples = spark.createDataFrame([("a",), ("b",)], "sample string")
    calls = spark.createDataFrame([("a", "l", 2, "A", "G", "het"), ("a", "l", 3, "C", "T", "alt"), ("b", "l", 2, "A", "G", "ref"), ("b", "l", 3, "C", None, "ref")],
                                  "sample string, locus string, pos long, ref string, alt string, code string")
    seqs = sequences.consensus(calls, loci, samples)
    assert {r["sample"]: r["seq"] for r in seqs.collect()} == {"a": "NRTN", "b": "NACN"}
    ranges = sequences.trim_ranges(sequences.column_stats(seqs))
    assert {r["sample"]: r["seq"] for r in sequences.trim_ends(seqs, ranges).collect()} == {"a": "RT", "b": "AC"}
    assert [tuple(r) for r in sequences.trimmed_bed(loci, ranges).collect()] == [("c", 1, 3, "l")]
    bad = spark.createDataFrame([("a", "l", "NN"), ("b", "l", "NN")], "sample string, locus string, seq string")
    r = sequences.trim_ranges(sequences.column_stats(bad)).first()
    assert r["trim_failed"] and (r["first_kept"], r["last_kept"], r["n_trimmed"]) == (1, 2, 0)
    assert sequences.missingness_per_sample(spark.createDataFrame([("a", "l", "")], "sample string, locus string, seq string")).first()["mean_pct_n"] == 100
    names = spark.createDataFrame([("x/1",), ("x:1",)], "locus string")
    assert {r["file_name"] for r in sequences.locus_file_names(names).collect()} == {"x_1", "x_1__2"}


def test_gap_split_spread_and_policies(spark):
    df = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate([0.5, 0.52, 0.55, 0.96, 0.98, 1.0])], "sample string, depth_ratio double")
    assert [r["sex"] for r in sex.split_at_gap(df).orderBy("sample").collect()] == ["hetero"] * 3 + ["homo"] * 3
    flat = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("c", "x", 9.0)], "sample string, sex string, v double")
    assert {r["v_z"] for r in sex.robust_z(flat, ["v"], "sex").collect()} == {0.0}
    classes = spark.createDataFrame([("a", "paralog"), ("b", "gametolog"), ("c", "PAR-like")], "locus string, class string")
    lists = {p: {r["locus"] for r in sex.exclusion_list(classes, p).collect()} for p in ("all", "paralogs", "gametologs", "none")}
    assert lists == {"all": {"a", "b", "c"}, "paralogs": {"a", "b"}, "gametologs": {"b"}, "none": set()}
    loci = spark.createDataFrame([("chrZ", 0, 5, "l")], schemas.LOCI)
    assert sex.sex_loci(loci, "chrZ").count() == 1
    with pytest.raises(ValueError):
        sex.sex_loci(loci, "chrW")
    with pytest.raises(ValueError):
        sex.exclusion_list(classes, "some")


def test_stages_ranks_and_percentages(spark):
    df = spark.createDataFrame([("a", True, True, None), ("b", False, True, 5.0), ("c", False, False, 50.0), ("d", False, False, None)], "sample string, retained boolean, contam boolean, mean_pct_n double")
    assert [r["stage"] for r in qc_tables.stage_sample(df).orderBy("sample").collect()] == ["retained", "flagged contaminant", "missingness", "no data"]
    ties = spark.createDataFrame([(1,), (1,), (3,)], "v int").withColumn("g", F.lit(1))
    assert sorted(r["k"] for r in qc_tables.average_rank(ties, "v", "g", "k").collect()) == [1.5, 1.5, 3.0]
    none = spark.createDataFrame([("a", "l", 0, 0, 0, 4)], "sample string, locus string, n_het int, n_alt int, n_ref int, n_miss int")
    pct = {r["metric"]: r["pct"] for r in qc_tables.counts_long(none).collect()}
    assert pct == {"n_het": None, "n_alt": None, "n_diff": None, "n_miss": 100.0}
    base, extra = spark.createDataFrame([("a", 1)], "sample string, x int"), spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "sample string, x int")
    keep = spark.createDataFrame([("a",), ("b",)], "sample string")
    assert {(r["sample"], r["x"]) for r in qc_tables.append_missing(base, extra, "sample", keep).collect()} == {("a", 1), ("b", 2)}
    assert [r["sample"] for r in sites.rarefied(extra, 2, seed=1).collect()] == [r["sample"] for r in sites.rarefied(extra, 2, seed=1).collect()]


def test_readers(spark, tmp_path):
    (tmp_path / "run_s1.vcf").write_text("##x\n#CHROM\nc\t7\t.\tA\tC,G\t.\tPASS\t.\tGT:DP:AO:RO\t0|1:12:6,.:5\nc\t8\t.\tA\t.\t9.5\tq1;q2\t.\tGT:GQ\t./.:3\n")
    a, b = readers.read_vcf(spark, str(tmp_path / "run_s1.vcf")).orderBy("pos").collect()
    assert (a["sample"], a["alt"], a["gt"], a["dp"], a["ao"], a["ro"], a["qual"], a["filter"]) == ("s1", ["C", "G"], [0, 1], 12, [6, None], 5, None, [])
    assert (b["alt"], b["gt"], b["gq"], b["dp"], b["filter"]) == ([], [None, None], 3.0, None, ["q1", "q2"])
    (tmp_path / "x_s2.fa").write_text(">l1 \nAC\nG T\n>l2\n\n")
    assert [tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "x_s2.fa")).orderBy("locus").collect()] == [("s2", "l1", "ACGT"), ("s2", "l2", "")]
    (tmp_path / "s3.stats").write_text("# c\nSN\traw total sequences:\t0\nSN\treads mapped:\t0\t# note\n")
    r = readers.with_rates(readers.read_mapping_stats(spark, str(tmp_path / "s3.stats"))).first()
    assert (r["sample"], r["n_reads"], r["pct_mapped"]) == ("s3", 0.0, 0.0)
    (tmp_path / "s4.metrics").write_text("## METRICS\nLIBRARY\ta\nlib\t1\t2\t3\t4\t5\t6\t7\t0.25\t9\n\n")
    assert readers.read_duplication(spark, str(tmp_path / "s4.metrics")).first()["pct_duplication"] == 25.0
    (tmp_path / "s5.flagstat").write_text("9 + 0 mapped\n7 + 1 primary mapped (5%)\n")
    assert readers.read_flagstat(spark, str(tmp_path / "s5.flagstat")).first()["n_primary_mapped"] == 7
    with gzip.open(tmp_path / "s6_R1.fastq.gz", "wt") as f:
        f.write("@i:12:FC:1:2:3:4 1:N\nACGT\n")
    assert tuple(readers.read_seq_batch(spark, str(tmp_path / "s6_R1.fastq.gz")).first()) == ("s6", "i", "12", "FC", "12_FC")
    (tmp_path / "s7_R1.fastq").write_text("@bad:1\nA\n")
    with pytest.raises(Exception, match="under 7 fields"):
        readers.read_seq_batch(spark, str(tmp_path / "s7_R1.fastq")).collect()
    (tmp_path / "ids.txt").write_text("a\n\n b \n")
    assert [r["sample"] for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    assert readers.read_ids(spark, str(tmp_path / "absent.txt")).count() == 0
    paths = spark.createDataFrame([("/d/x_s1_R1.fq.gz",), ("/d/x_s1_R2.fq.gz",), ("/d/y_s2_R1.fq.gz",)], "path string")
    assert [tuple(r) for r in readers.build_samplesheet(paths).collect()] == [("s1", "s1", 1, "/d/x_s1_R1.fq.gz", "/d/x_s1_R2.fq.gz")]
    with pytest.raises(Exception, match="several files"):
        readers.build_samplesheet(paths.unionByName(paths)).collect()
    with pytest.raises(Exception, match="without metadata"):
        readers.build_samplesheet(paths, known=spark.createDataFrame([("s2",)], "sample string")).collect()
    with gzip.open(tmp_path / "s8_R1.fastq.gz", "wt") as f:
        f.write("")
    with pytest.raises(Exception, match="under 7 fields"):
        readers.read_seq_batch(spark, str(tmp_path / "s8_R1.fastq.gz")).collect()


def test_writers_and_stream(spark, tmp_path):
    bed = spark.createDataFrame([("c", 5, 9, "m"), ("c", 0, 4, "l")], schemas.LOCI)
    writers.write_bed(bed, str(tmp_path / "bed"))
    assert [r["locus"] for r in readers.read_bed(spark, str(tmp_path / "bed")).orderBy("start").collect()] == ["l", "m"]
    seqs = spark.createDataFrame([("b", "x/1", "AC"), ("a", "x/1", "GT")], "sample string, locus string, seq string")
    writers.write_fasta_by_locus(seqs, str(tmp_path / "fasta"))
    (file,) = (tmp_path / "fasta" / "file_name=x_1").glob("part-*")
    assert file.read_text() == ">a\nGT\n>b\nAC\n"
    calls = spark.createDataFrame([("a", "c", 1, "l", "het", 9), ("b", "c", 1, "l", "ref", 3)], CALLS)
    writers.write_sites(calls, str(tmp_path / "sites"))
    assert writers.read_sites(spark, str(tmp_path / "sites")).count() == 1
    calls.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        count_arrivals(spark, str(tmp_path / "in"), calls.schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r)[:5] for r in spark.read.parquet(str(tmp_path / "out") + "/*").collect()] == [("l", "c", 1, 1, 2)]


def test_names_of_intervals(spark):
    row = spark.range(1).select(g.interval_of_region(F.lit("chr:1:5-9")).alias("a"), g.interval_of_locus(F.lit("X_y_L10_NC_01.1_5-9.fa")).alias("b")).first()
    assert tuple(row["a"]) == ("chr:1", 4, 9) and tuple(row["b"]) == ("NC_01.1", 4, 9)
    with pytest.raises(Exception, match="no interval"):
        spark.range(1).select(g.interval_of_region(F.lit("chr1"))).collect()


def test_optional_tables_and_contamination(spark):
    meta = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "sample string, contam boolean")
    got = qc_tables.with_contam(meta, spark.createDataFrame([("a",), ("c",)], "sample string")).orderBy("sample").collect()
    assert [(r["contam"], r["contam_source"]) for r in got] == [(True, "metadata"), (False, None), (True, "QC")]
    assert qc_tables.join_optional(meta, None, "sample", "x long").schema["x"].dataType.simpleString() == "bigint"
    stages = spark.createDataFrame([(False, False, False, "paralog", 9, True), (False, False, False, None, 9, True), (False, False, False, None, 900, False)], "retained boolean, excess_het boolean, ab_skew boolean, z_class string, length int, kept_missing boolean")
    assert [r["stage"] for r in qc_tables.stage_locus(stages).collect()] == ["Z (paralog)", "too short", "missingness"]


def test_nearest_indels_in_both_directions(spark):
    rng = random.Random(6)
    rows = [("s", "c", p, rng.random() < 0.2) for p in sorted(rng.sample(range(300), 60))]
    at = [p for _, _, p, x in rows if x]
    got = sites.nearest_indel(spark.createDataFrame(rows, "sample string, chrom string, pos long, is_indel boolean")).collect()
    for r in got:
        before, after = max((p for p in at if p <= r["pos"]), default=None), min((p for p in at if p >= r["pos"]), default=None)
        assert r["indel_dist"] == min(abs(r["pos"] - x) for x in (before, after) if x is not None)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BASES = "sample string, locus string, pos long, ref string, alt string, code string"


def test_consensus_of_repeats_gaps_and_places_outside(spark):
    loci = spark.createDataFrame([("c", 0, 4, "l"), ("c", 10, 14, "m"), ("c", 3, 6, "none")], schemas.LOCI)
    samples = spark.createDataFrame([("a",), ("b",)], "sample string")
    rows = [("a", "l", 2, "A", "G", "het"), ("a", "l", 2, "A", "G", "het"), ("a", "l", 3, "C", "T", "alt"), ("a", "l", 3, "C", None, "miss"), ("b", "l", 2, "A", "G", "ref"), ("b", "l", 2, "A", "C", "alt"), ("b", "l", 3, "C", None, "ref")]
    rows += [("a", "m", p, "T", None, "ref") for p in (8, 10, 12, 15, 99)] + [("b", "m", 14, "T", "T", "miss")]
    got = {(r["sample"], r["locus"]): r["seq"] for r in sequences.consensus(spark.createDataFrame(rows, BASES), loci, samples).collect()}
    assert got == {("a", "l"): "NRTN", ("b", "l"): "NNCN", ("a", "m"): "NTNN", ("b", "m"): "NNNN", ("a", "none"): "NNN", ("b", "none"): "NNN"}


def test_consensus_of_a_long_locus(spark):
    n = 400_000
    loci, one = spark.createDataFrame([("c", 5, 5 + n, "l")], schemas.LOCI), spark.createDataFrame([("a",)], "sample string")
    at = spark.range(1, n + 1).filter("id % 7 <> 0 and (id < 120000 or id > 170000)")  # whole runs without a call
    calls = at.select(F.lit("a").alias("sample"), F.lit("l").alias("locus"), (F.col("id") + 5).alias("pos"), F.substring(F.lit("ACGT"), (F.col("id") % 4 + 1).cast("int"), F.lit(1)).alias("ref"), F.lit(None).cast("string").alias("alt"), F.lit("ref").alias("code"))
    assert sequences.consensus(calls, loci, one).first()["seq"] == "".join("N" if i % 7 == 0 or 120000 <= i <= 170000 else "ACGT"[i % 4] for i in range(1, n + 1))


def test_merged_sites_of_repeats_and_of_two_lots(spark):
    rows = [("b", 1, "A", "ref"), ("b", 1, "A", "het"), ("a", 1, "A", "alt"), ("a", 1, "A", "het"), ("c", 1, "A", "miss"), ("c", 1, "G", "ref"), ("a", 2, "T", "miss"), ("x", 3, "T", "ref")]
    calls = spark.createDataFrame([(s, "c", p, r, k) for s, p, r, k in rows], "sample string, chrom string, pos long, ref string, code string")
    numbers = sites.numbered(spark.createDataFrame([("c",), ("a",), ("b",), ("b",)], "sample string"))
    assert sorted(map(tuple, numbers.collect())) == [("a", 0), ("b", 1), ("c", 2)]
    want = {(1, "A"): ([0, 1], [2, 1]), (1, "G"): ([2], [0]), (2, "T"): ([], [])}
    merged = sites.merge_samples(calls, numbers)
    lots = sites.join_sites(sites.merge_samples(calls.filter("sample = 'a'"), numbers), sites.merge_samples(calls.filter("sample <> 'x'"), numbers))  # a twice
    for got in (merged, lots):
        assert {(r["pos"], r["ref"]): (r["carriers"], r["codes"]) for r in got.collect()} == want
    long = {tuple(r) for r in sites.site_calls(merged, numbers).collect()}
    assert long == {("a", "c", 1, "A", "alt"), ("b", "c", 1, "A", "het"), ("c", "c", 1, "G", "ref")}
    assert {tuple(r) for r in sites.site_calls(sites.merge_samples(spark.createDataFrame(long, calls.schema), numbers), numbers).collect()} == long


def test_a_site_of_a_large_cohort_is_one_vector(spark):
    n = 100_000
    calls = spark.range(n).select(F.col("id").alias("sample"), F.lit("c").alias("chrom"), F.lit(1).cast("long").alias("pos"), F.lit("A").alias("ref"), F.when(F.col("id") % 3 == 0, "miss").when(F.col("id") % 3 == 1, "ref").otherwise("het").alias("code"))
    r = sites.merge_samples(calls, sites.numbered(calls.select("sample"))).first()
    assert r["carriers"] == [i for i in range(n) if i % 3] and r["codes"] == [i % 3 - 1 for i in range(n) if i % 3]


def test_rarefaction_is_that_of_each_set(spark):
    rng = random.Random(3)
    loci = spark.createDataFrame([("c", 0, 30, "l"), ("c", 50, 60, "m")], schemas.LOCI)
    samples = spark.createDataFrame([(f"s{i}",) for i in range(12)], "sample string")
    calls = [(f"s{i}", "c", p, "l" if p <= 30 else "m" if p < 60 else "gone", rng.choice(["ref", "ref", "het", "alt", "miss"]), 9) for i in range(12) for p in [*range(1, 31), 55, 70] if rng.random() < 0.7]
    df, sizes = spark.createDataFrame(calls, CALLS), (7, 3, 12, 40)
    got = {r["n"]: r for r in sites.rarefaction(df, loci, samples, sizes, seed=5).collect()}
    assert set(got) == set(sizes)
    for n in sizes:
        own = df.join(sites.rarefied(samples, n, 5), "sample", "left_semi")
        total = sites.informativeness_totals(sites.locus_informativeness(own, loci, n)).first()
        assert [got[n][c] or 0 for c in ("n_scored", "n_variable", "n_pi", "pct_pi")] == [total[c] or 0 for c in ("n_scored", "n_variable", "n_pi", "pct_pi")]


def test_complex_alleles_become_snps_and_one_indel(spark):
    def atoms(ref, alt):
        rows = oc.atomize(raw(spark, {"pos": 10, "ref": ref, "alt": [alt], "gt": [0, 1]})).collect()
        return sorted((r["pos"], r["ref"], r["alt"][0]) for r in rows)

    assert atoms("ACTA", "CGA") == [(10, "A", "C"), (11, "C", "G"), (11, "CT", "C")]
    assert atoms("AC", "T") == [(10, "A", "T"), (10, "AC", "A")]  # the base before the indel differs too
    assert atoms("CAATT", "CATT") == [(10, "CA", "C")]  # what both share at the right goes, so the indel is on the left
    assert atoms("G", "GTT") == [(10, "G", "GTT")]
    assert atoms("GAT", "GATT") == [(11, "A", "AT")]
    assert atoms("A", "*") == [(10, "A", "*")] and atoms("ACC", "<DEL>") == [(10, "ACC", "<DEL>")]
    left = oc.drop_indels(oc.atomize(raw(spark, {"pos": 10, "ref": "ACTA", "alt": ["CGA"], "gt": [1, 1], "ao": [9]})))
    assert [(r["pos"], r["ref"], r["alt"], r["gt"], r["ao"]) for r in left.orderBy("pos").collect()] == [(10, "A", ["C"], [1, 1], [9]), (11, "C", ["G"], [1, 1], [9])]
    rng, pairs = random.Random(9), []
    for i in range(300):
        a, b = ("".join(rng.choices("AC", k=rng.randint(1, 6))) for _ in "ab")
        if a != b and max(len(a), len(b)) > 1:
            pairs.append((f"s{i}", a, b))
    df = raw(spark, *[{"sample": s, "ref": a, "alt": [b], "gt": [0, 1]} for s, a, b in pairs])
    found = {}
    for r in oc.atomize(df).collect():
        found.setdefault(r["sample"], []).append((r["pos"] - 1, r["ref"], r["alt"][0]))
    for s, a, b in pairs:  # putting the rows into REF gives ALT
        own = sorted(found[s], key=lambda x: (-x[0], -len(x[1]) - len(x[2])))
        assert sum(len(r) != len(x) for _, r, x in own) == (len(a) != len(b))
        made = a
        for at, r, x in own:
            assert a[at : at + len(r)] == r
            made = made[:at] + x + made[at + len(r) :]
        assert made == b, (a, b, own)


def test_near_indels_as_pair_by_pair(spark):
    rng, rows = random.Random(4), []
    for s in ("s1", "s2"):
        for p in rng.choices(range(1, 400), k=150):
            rows.append({"sample": s, "pos": p} | rng.choice([{"ref": "ACGTT", "alt": ["A"]}, {"alt": ["AT"]}, {"alt": ["C"]}, {"alt": ["C"]}, {"alt": ["*"]}, {}, {}]))
    long = {"sample": "s1", "pos": 500, "ref": "A" * 90, "alt": ["A"]}
    rows += [long, *[{"sample": "s1", "pos": p, "alt": ["C"]} for p in (494, 495, 588, 594, 595)]]
    df = raw(spark, *rows)
    ends = [(r["sample"], r["pos"], r["pos"] + len(r.get("ref", "A")) - 1) for r in rows if any(len(a) != len(r.get("ref", "A")) and a != "*" for a in r.get("alt", []))]
    for gap in (1, 5, 30):
        want = Counter()
        for r in rows:
            a = r.get("alt", [])
            judged = a and not any(len(x) != len(r.get("ref", "A")) and x != "*" for x in a)
            want[r["sample"], r["pos"], len(r.get("ref", "A")), bool(judged and any(s == r["sample"] and b - gap <= r["pos"] <= e + gap for s, b, e in ends))] += 1
        assert Counter((r["sample"], r["pos"], len(r["ref"]), r["near_indel"]) for r in oc.tag_near_indel(df, gap).collect()) == want


def test_the_chain_shuffles_once(spark, tmp_path):
    raw(spark, {"pos": 10, "ref": "AT", "alt": ["A"], "gt": [0, 1]}, {"pos": 13, "alt": ["C"]}).write.parquet(str(tmp_path / "raw"))
    text = plan(oc.filter_chain(spark.read.parquet(str(tmp_path / "raw"))))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text and text.count("FileScan") == 1


def test_joins_where_one_bin_has_most_and_lengths_differ(spark):
    rng = random.Random(12)
    loci = [("c", a := rng.randint(0, 90_000), a + rng.choice([1, 5, 40, 900, 30_000]), f"l{k}") for k in range(70)] + [("c", 100, 140, "dense"), ("d", 0, 5, "end")]
    points = [("c", rng.randint(101, 128), k) for k in range(2700)] + [("c", rng.randint(1, 120_000), -k) for k in range(300)]  # nine in ten in one bin
    bed = spark.createDataFrame(loci, schemas.LOCI)
    at = spark.createDataFrame(points, "chrom string, pos long, k int").withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    want = sorted((k, n) for c, p, k in points for d, s, e, n in loci if c == d and s < p <= e)
    for limit, hot in ((0, 50), (0, 10**6), (1000, 50)):
        got = intervals.assign_locus(at, bed, bin=32, every=True, limit=limit, hot=hot)
        assert sorted((r["k"], r["locus"]) for r in got.collect()) == want
    spans = [("c", a := rng.randint(0, 90_000), a + rng.choice([1, 60, 20_000]), float(k)) for k in range(40)] + [("c", 100 + k % 20, 130, 1000.0 + k) for k in range(400)]
    expected = sorted((k, n, min(b, e) - max(a, s)) for c, a, b, k in spans for d, s, e, n in loci if c == d and min(b, e) > max(a, s))
    for limit in (0, 1000):
        got = intervals.overlaps(spark.createDataFrame(spans, schemas.WINDOWS), bed, bin=32, limit=limit, hot=50)
        assert sorted((r["depth"], r["b_locus"], r["overlap"]) for r in got.collect()) == expected
    assert intervals.assign_locus(at, bed.limit(0)).count() == 0 and intervals.overlaps(bed.limit(0), bed).count() == 0


def test_ranks_without_one_task_for_all(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 101).alias("v"), (F.col("id") % 3 / 4).alias("x"))
    ranked = ranks.with_rank(df, F.desc("v"), "id", total="n", running={"v": "upto", "x": "xs"})
    assert "SinglePartition" not in plan(ranked)
    upto = xs = 0
    for k, (r, i) in enumerate(zip(ranked.orderBy("rank").collect(), sorted(range(1000), key=lambda i: (-(i * 7919 % 101), i)), strict=True)):
        upto, xs = upto + i * 7919 % 101, xs + i % 3 / 4
        assert (r["id"], r["rank"], r["upto"], r["xs"], r["n"]) == (i, k + 1, upto, xs, 1000)
    assert ranks.with_rank(df.limit(0), "id", total="n", running={"v": "upto"}).count() == 0
    ratios = df.select(F.col("id").alias("sample"), F.col("x").alias("depth_ratio"))
    shares = df.select(F.col("id").alias("locus"), F.col("v").alias("n_pi"))
    stats = df.select(F.col("id").alias("sample"), F.col("x").alias("mean_pct_n"))
    for rows in (sex.split_at_gap(ratios), cohort.percentiles_floor(df, "v"), sites.cumulative_share(shares), sequences.samples_by_missingness(stats, place="p")):
        windows = rows._jdf.queryExecution().optimizedPlan().toString().split("windowspecdefinition(")[1:]
        assert windows and all(w.startswith("_part") for w in windows)
    assert {r["sex"]: r["count"] for r in sex.split_at_gap(ratios).groupBy("sex").count().collect()} == {"hetero": 334, "homo": 666}


def test_equal_missingness_in_any_order_of_loci(spark):
    shares = [(k, 7 + 3 * (k % 11)) for k in range(1, 40)]  # missing letters and length of each locus
    rng = random.Random(5)
    rows = []
    for sample in range(40):
        rng.shuffle(shares)
        rows += [(sample, locus, "N" * min(k, n) + "A" * (n - min(k, n))) for locus, (k, n) in enumerate(shares)]
    rows += [(40, locus, "") for locus in range(39)]
    seqs = spark.createDataFrame(rows, "sample int, locus int, seq string").coalesce(1)
    stats = sequences.missingness_per_sample(seqs)
    exact = float(sum(Fraction(100 * min(k, n), n) for k, n in shares) / 39)
    assert {r["sample"]: (r["mean_pct_n"], r["n_loci"]) for r in stats.collect()} == {i: (exact if i < 40 else 100.0, 39) for i in range(41)}
    placed = sequences.samples_by_missingness(stats, place="p")
    assert {r["sample"]: r["p"] for r in placed.collect()} == {40: 1} | {i: i + 2 for i in range(40)}


def test_a_file_a_sample_without_a_list_in_the_driver(spark, tmp_path):
    rows = [(f"s_{i} +%/{i}", f"@M{i % 3}:{i}:FC:1:2:3:4 1:N\nACGT") for i in range(300)] + [("twice", "@M1:7:FC:1:2:3:4 1:N")] * 2
    files = writers.write_texts(spark.createDataFrame(rows, "sample string, value string"), str(tmp_path / "fq"), ".fastq.gz")
    got = readers.read_seq_batch(spark, files)
    assert "binaryFile" not in plan(got) and got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert len(files.inputFiles()) < 20  # tables of paths, not the 301 files
    want = {name: (f"M{i % 3}", str(i), "FC", f"{i}_FC") for i, (name, _) in enumerate(rows[:300])} | {"twice": ("M1", "7", "FC", "7_FC")}
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    names = sorted(p.relative_to(tmp_path / "fq").parts[-1] for p in (tmp_path / "fq").rglob("*") if p.is_file())
    assert names == ["part-0.fastq.gz"] * 301 and gzip.open(tmp_path / "fq/sample=twice/part-0.fastq.gz", "rt").read() == (rows[-1][1] + "\n") * 2
    assert {r[0] for r in readers.read_seq_batch(spark, f"{tmp_path}/fq/*/part-*.gz").collect()} >= {"twice"}  # Spark's readers find them too
    assert writers.write_texts(spark.createDataFrame([], "sample string, value string"), str(tmp_path / "none")).count() == 0


def test_summaries_of_many_samples_from_tables_of_paths(spark, tmp_path):
    write = lambda name, *lines: writers.write_texts(spark.createDataFrame([(f"x_{i}", line.format(i=i)) for i in range(50) for line in lines], "sample string, value string"), str(tmp_path / name))
    dup = write("dup", "## METRICS\nLIBRARY\tA\nlib\t1\t2\t3\t4\t5\t6\t7\t0.{i:02d}\t9\n")
    depth = write("depth", "chrom\tlength\tbases\nchr1\t10\t99\ntotal\t100\t{i}\ntotal_region\t5\t5")
    flagstat = write("flagstat", "9 + 0 mapped (1%)\n{i} + 1 primary mapped (5%)\n")
    for read, table, names in ((readers.read_duplication, dup, "dup"), (readers.read_depth_summary, depth, "depth"), (readers.read_flagstat, flagstat, "flagstat")):
        got, listed = read(spark, table), read(spark, f"{tmp_path}/{names}/*/part-*")
        assert len(got.inputFiles()) < 20 < len(listed.inputFiles())
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.collect())) and got.count() == 50
    assert {r["sample"]: r["genome_dp"] for r in readers.read_depth_summary(spark, depth).collect()} == {f"x_{i}": i / 100 for i in range(50)}


def test_depth_by_distance_and_region_from_one_join(spark, tmp_path):
    probes = spark.createDataFrame([("c", 10, 20, "l"), ("c", 40, 900, "m")], schemas.LOCI)
    calls = spark.createDataFrame([("a", "c", p, "l", "miss" if p % 5 == 0 else "ref", p % 7) for p in range(1, 60)], CALLS)
    calls.write.parquet(str(tmp_path / "calls"))
    both = sites.depth_profiles(spark.read.parquet(str(tmp_path / "calls")), probes, buffer=8, bin=4, long_from=100)
    assert "Expand" in plan(both)
    levels = {(r["class"], r["region"], r["bin"]): (r["n_pos"], r["n_called"]) for r in both.collect()}
    for name, by in (("bin", False), ("region", True)):
        one = sites.depth_profile(calls, probes, buffer=8, bin=4, long_from=100, by_region=by)
        assert {(r["class"], r[name]): (r["n_pos"], r["n_called"]) for r in one.collect()} == {(c, r if by else b): v for (c, r, b), v in levels.items() if (b is None) == by}
    assert levels["short", "probe", None] == (10, 8) and levels["long", None, -4] == (4, 3)


def test_two_passes_leave_nothing_cached(spark):
    rng = random.Random(2)
    loci = spark.createDataFrame([("chrZ", 10 * k, 10 * k + 9, f"z{k}") for k in range(4)] + [("c", 0, 9, "a")], schemas.LOCI)
    calls = [(f"s{i}", "chrZ" if k < 4 else "c", (10 * k if k < 4 else 0) + p, f"z{k}" if k < 4 else "a", rng.choice(["ref", "het"]) if i % 2 else "ref", 10 if i % 2 == 0 and k < 4 else 20) for i in range(10) for k in range(5) for p in range(1, 9)]
    df, samples = spark.createDataFrame(calls, CALLS), spark.createDataFrame([(f"s{i}",) for i in range(10)], "sample string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    own = counts.counts_per_locus(df, loci, samples)
    sexes, classes = sex.two_passes(own, df, sex.sex_loci(loci, "chrZ"))
    assert {r["class"] for r in classes.collect()} == {"hemizygous"} and {r["sex"] for r in sexes.filter("sample in ('s0', 's2')").collect()} == {"hetero"}
    told = {r["sample"]: r for r in sex.sex_statistics(own, loci, sexes, classes).collect()}
    assert told["s0"]["hemi_depth"] == 10 and told["s1"]["hemi_depth"] == 20
    assert {r["hemi_depth"] for r in sex.sex_statistics(own, loci, sexes, classes.filter("false")).collect()} == {0}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_hub_is_read_without_a_shuffle(spark, tmp_path):
    rng = random.Random(8)
    calls = [(f"s{i}", "c", 100 * k + p, f"l{k}", rng.choice(["ref", "het", "alt", "miss"]), 9) for i in range(9) for k in range(7) for p in range(1, 20)]
    df = spark.createDataFrame(calls, CALLS)
    loci = spark.createDataFrame([("c", 100 * k, 100 * k + 19, f"l{k}") for k in range(7)], schemas.LOCI)
    hub.drop(spark, "hub_t")
    for lot in ("sample < 's3'", "sample < 's6'", "true"):
        hub.add_samples(df.filter(lot), "hub_t", f"file://{tmp_path}/hub", buckets=4)
    own = hub.read_hub(spark, "hub_t")
    assert sorted(map(tuple, own.collect())) == sorted(calls)
    het, info = cohort.per_site_het(own, 9), sites.locus_informativeness(own, loci, 9)
    assert "Exchange" not in plan(het)
    assert "Exchange hashpartitioning" not in plan(cohort.per_locus_het(het, F.broadcast(loci), 9)) and "hashpartitioning(locus" not in plan(own.groupBy("locus", "pos").count().groupBy("locus").count())
    assert sorted(map(tuple, het.collect())) == sorted(map(tuple, cohort.per_site_het(df, 9).collect()))
    assert sorted(map(tuple, info.collect())) == sorted(map(tuple, sites.locus_informativeness(df, loci, 9).collect()))
    hub.drop(spark, "hub_t")


def test_fasta_with_marks_in_headers_and_in_runs(spark, tmp_path):
    rng = random.Random(1)
    want = {"l1 a>b": "ACGT", "l2": "", "chr>1": "".join(rng.choices("ACGTN", k=5000)), "l4": "T" * 31}
    text = "".join(f">{k} \n" + "".join(v[i : i + 31] + "\r\n" for i in range(0, len(v), 31)) for k, v in want.items())
    (tmp_path / "x_s1.fa").write_bytes(text.encode())
    (tmp_path / "x_s2.fa").write_text(">only\nAC G\n\nT")
    read = lambda: {(r["sample"], r["locus"]): r["seq"] for r in readers.read_fasta(spark, f"{tmp_path}/*.fa").collect()}
    all_ = {("s1", k): v for k, v in want.items()} | {("s2", "only"): "ACGT"}
    assert read() == all_
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700", "40", kept):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if size != kept else "4194304")
        try:
            rows = readers.read_fasta_runs(spark, f"{tmp_path}/*.fa", run=100).collect()
            assert read() == all_
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
            spark.conf.set("spark.sql.files.openCostInBytes", "4194304")
        found = {}
        for r in sorted(rows, key=lambda r: r["start"]):
            seq = found.setdefault((r["sample"], r["locus"]), "")
            assert len(r["seq"]) <= 100 and r["start"] == len(seq)
            found[r["sample"], r["locus"]] = seq + r["seq"]
        assert found == all_
    (tmp_path / "bad_s3.fasta").write_text("ACGT\n>x\nA\n")
    with pytest.raises(Exception, match="before the first header"):
        readers.read_fasta_runs(spark, f"{tmp_path}/*.fasta").collect()
