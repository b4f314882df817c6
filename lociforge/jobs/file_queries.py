"""Queries whose rows go through files: views written in the formats of the field and read back.

Files are made from the given tables, in a new folder of the shared one; a folder sample=... is a sample's file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociforge.jobs import views as v
from lociforge.jobs.queries import _COUNTS, _INFO, _RAW, _SEQS, _SITES
from lociforge.jobs.registry import new_folder, query, rounded, sample_count
from lociforge.operators import cohort, counts, qc_tables, sequences, sites
from lociforge.operators.stored import stored
from lociforge.sources import hub, readers, schemas, writers


def _text(df: DataFrame, line: Column, path: str, ending: str = "", compression: str = "none") -> str:
    """Lines of text in a folder for each sample."""
    rows = df.select("sample", line.alias("value")).repartition("sample")
    rows.write.partitionBy("sample").option("compression", compression).text(path)
    return f"{path}/*/part-*{ending}"


def _tabs(*columns: str) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])


@query(f"""{_RAW} select sample::varchar as sample, chrom, pos, ref || case kind when 'indel' then 'A' when 'block' then 'CG' when 'mnv' then 'CT' when 'complex' then 'CTA' else '' end as ref,
    case kind when 'indel' then ref when 'block' then '' when 'mnv' then alt || 'CA' when 'complex' then alt || 'GA' when 'two' then alt || ',' || alt2 else case when has_alt then alt else '' end end as alt,
    qual::double as qual, case when code = 'miss' then './.' when kind = 'block' then '0/0' when kind = 'two' then '1/2' when code = 'het' then '0/1' when code = 'alt' then '1/1' else '0/0' end as gt,
    dp1::int as dp, gq::double as gq, ro::int as ro, ao || case when kind = 'two' then ',' || ro else '' end as ao from raw""")
def vcf_files(spark, d):
    """Raw calls through VCF files of one sample each."""
    path = new_folder(spark, "vcf")
    writers.write_vcf(v.raw_calls(spark, d), path)
    rows = readers.read_vcf(spark, f"{path}/*/part-*")
    joined = lambda c, none: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(none))), "/")
    return rows.select("sample", "chrom", "pos", "ref", F.array_join("alt", ",").alias("alt"), "qual", joined("gt", ".").alias("gt"), "dp", "gq", F.col("ro").cast("int").alias("ro"), F.array_join("ao", ",").alias("ao"))


@query("select chrom, start, \"end\", locus::varchar as locus from loci")
def bed_files(spark, d):
    """Intervals through a BED file."""
    path = new_folder(spark, "bed")
    writers.write_bed(v.loci(spark, d).withColumn("locus", F.col("locus").cast("string")), path)
    return readers.read_bed(spark, path)


@query(f"{_SEQS} select sample::varchar as sample, locus::varchar as locus, seq from seqs")
def fasta_files(spark, d):
    """Sequences through FASTA files of one locus each, their names read back."""
    path = new_folder(spark, "fasta")
    seqs = sequences.consensus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d)).withColumn("locus", F.col("locus").cast("string"))
    writers.write_fasta_by_locus(seqs, path)
    rows = readers.read_fasta(spark, f"{path}/file_name=*/part-*", key="file_name")
    return rows.select(F.col("locus").alias("sample"), F.col("sample").alias("locus"), "seq")


@query(f"""{_SEQS}, whole as (select locus, sample, seq from seqs), runs as (select locus, sample, unnest(range(0, length(seq), 7)) as start, seq from whole)
select locus::varchar as sample, sample::varchar as locus, start::bigint as start, substr(seq, start::bigint + 1, 7) as seq from runs""")
def fasta_runs(spark, d):
    """The same files read in runs of letters, as chromosomes are (S3)."""
    path = new_folder(spark, "fasta")
    seqs = sequences.consensus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d)).withColumn("locus", F.col("locus").cast("string"))
    writers.write_fasta_by_locus(seqs, path)
    return readers.read_fasta_runs(spark, f"{path}/file_name=*/part-*", run=7, key="file_name")


def _hub(spark, d) -> str:
    """A hub of all calls, made in two lots of samples, one of which comes twice."""
    name, own = f"hub_{uuid.uuid4().hex}", v.calls(spark, d)
    path = new_folder(spark, "hub")
    for lot in ("sample % 2 = 0", "sample % 2 = 0 or sample % 3 = 0", "true"):
        hub.add_samples(own.filter(lot), name, path, buckets=16)
    return name


@query(f"{_SITES} select locus, chrom, pos, n_het, n - called as n_miss, called, round(f, 6) as f from scored")
def hub_sites(spark, d):
    """Sites of a hub to which samples were added in lots."""
    name = _hub(spark, d)
    rows = stored(cohort.per_site_het(hub.read_hub(spark, name), sample_count(spark, d)), "sites")
    hub.drop(spark, name)
    return rounded(rows)


@query(f"{_SITES}, {_INFO} select s.locus, s.n_sites, s.n_excess, s.total_het, i.n_scored, i.n_variable, i.n_pi from locus_stats s join info i on s.locus = i.locus")
def hub_loci(spark, d):
    """Excess het and informative sites by locus from the hub."""
    name, n = _hub(spark, d), sample_count(spark, d)
    own, loci = hub.read_hub(spark, name), v.loci(spark, d)
    het = cohort.excess_het_loci(own, loci, n).select("locus", "n_sites", "n_excess", "total_het")
    rows = stored(het.join(sites.locus_informativeness(own, loci, n).select("locus", "n_scored", "n_variable", "n_pi"), "locus"), "loci")
    hub.drop(spark, name)
    return rows


@query("select query::varchar as query, subject::varchar as subject, pident::double as pident, evalue::double as evalue, bitscore, qcov::double as qcov, sstart, send from hits")
def hit_files(spark, d):
    """Hits through a table of 18 columns."""
    path = new_folder(spark, "hits")
    names = [f.split()[0] for f in schemas.HITS.split(", ")]
    own = v.hits(spark, d)
    writers.write_tsv(own.select(*[F.col(c) if c in own.columns else F.lit(None).cast("string").alias(c) for c in names]), path)
    return readers.read_hits(spark, path).select("query", "subject", "pident", "evalue", "bitscore", "qcov", "sstart", "send")


@query(f"{_COUNTS} select sample::varchar as sample, locus::varchar as locus, n_het::int as n_het, n_miss::int as n_miss, round(mean_dp, 6) as mean_dp from counts")
def count_files(spark, d):
    """Counts through a table for each sample, missing depths as NA."""
    path = new_folder(spark, "counts")
    own = counts.counts_per_locus(v.calls(spark, d), v.loci(spark, d), v.samples(spark, d))
    columns = ("locus", "n_het", "n_alt", "n_ref", "n_miss", "mean_dp", "n_dp")
    rows = readers.read_per_sample(spark, _text(own, _tabs(*columns), path), schemas.COUNTS, r"\.txt", header=False)
    return rounded(rows.select("sample", "locus", "n_het", "n_miss", "mean_dp"))


@query("select sample, null::bigint as n_sites, null::double as gap from samples")
def absent_input(spark, d):
    """A table that is not there: its columns are null and the job goes on."""
    path = new_folder(spark, "absent")
    part = readers.read_optional(readers.read_tsv, f"{path}/*.tsv", "sample long, n_sites long, gap double", columns="sample long, n_sites long, gap double", spark=spark)
    return qc_tables.join_optional(v.samples(spark, d), part, "sample")


@query("select sample::varchar as sample from meta where contam")
def id_lists(spark, d):
    """A list of IDs through a file with blank lines; a missing list is empty."""
    path = new_folder(spark, "ids")
    flagged = v.meta(spark, d).filter("contam").select(F.concat(F.lit(" "), F.col("sample").cast("string")).alias("value"))
    flagged.unionByName(v.samples(spark, d).select(F.lit("").alias("value"))).write.text(path)
    return readers.read_ids(spark, path).unionByName(readers.read_ids(spark, f"{path}-absent/x.txt"))


@query("select sample::varchar as sample, species, state, contam, case when land_type = 1 then 'urban' end as land_type from meta")
def metadata_files(spark, d):
    """Metadata with TRUE, FALSE and NA through a table."""
    path = new_folder(spark, "meta")
    land = F.when(F.col("land_type") == 1, "urban")
    rows = v.meta(spark, d).select("sample", "species", F.lit(None).cast("string").alias("locality"), F.lit(None).cast("string").alias("city"), "state", F.upper(F.col("contam").cast("string")).alias("contam"), land.alias("land_type"))
    writers.write_tsv(rows, path)
    return readers.read_metadata(spark, path).select("sample", "species", "state", "contam", "land_type")


def _stats(spark, d, path: str) -> str:
    rows = v.mapping(spark, d)
    keys = {"raw total sequences": "n_reads", "reads mapped": "n_mapped", "reads properly paired": "n_paired", "reads MQ0": "n_mq0"}
    lines = F.concat_ws("\n", F.lit("# header"), *[F.concat(F.lit(f"SN\t{k}:\t"), F.col(c).cast("string"), F.lit("\t# note")) for k, c in keys.items()], F.lit("FFQ\t1\t2"))
    return _text(rows, lines, path)


@query("select sample::varchar as sample, n_reads::double as n_reads, round(100 * n_mapped / n_reads, 6) as pct_mapped, round(100 * n_paired / n_reads, 6) as pct_paired, round(100 * n_mq0 / n_reads, 6) as pct_mq0 from mapping")
def mapping_files(spark, d):
    """Mapping summaries of each sample, and their rates."""
    rows = readers.with_rates(readers.read_mapping_stats(spark, _stats(spark, d, new_folder(spark, "stats"))))
    return rounded(rows.select("sample", "n_reads", "pct_mapped", "pct_paired", "pct_mq0"))


@query("select sample::varchar as sample, round(100 * n_duplicate / n_reads, 6) as pct_duplication, round(n_reads / 1000, 6) as genome_dp, n_mapped as n_primary_mapped from mapping")
def duplicate_depth_flagstat_files(spark, d):
    """Duplicate metrics, depth summaries and flagstat files, joined."""
    own = stored(v.mapping(spark, d), "mapping")
    files = lambda name, text: writers.write_texts(own.select("sample", text.alias("value")), new_folder(spark, name))
    share = F.format_string("%.15f", F.col("n_duplicate") / F.col("n_reads"))
    metrics = F.concat(F.lit("## METRICS\nLIBRARY\tA\tB\nlib\t1\t2\t3\t4\t5\t6\t7\t"), share, F.lit("\t9\n"))
    a = readers.read_duplication(spark, files("dup", metrics))
    depth = F.concat(F.lit("chrom\tlength\tbases\nchr1\t10\t99\ntotal\t1000\t"), F.col("n_reads").cast("string"), F.lit("\ntotal_region\t5\t5"))
    b = readers.read_depth_summary(spark, files("depth", depth))
    flagstat = F.concat(F.col("n_reads").cast("string"), F.lit(" + 0 mapped (1%)\n"), F.col("n_mapped").cast("string"), F.lit(" + 0 primary mapped (2%)\n"))
    c = readers.read_flagstat(spark, files("flagstat", flagstat))
    return rounded(a.join(b.hint("merge"), "sample").join(c.hint("merge"), "sample"))  # a table of paths is small where its texts are not: no broadcast


@query("select sample::varchar as sample, count(*) as n, sum(\"end\" - start)::bigint as bp, round(sum(depth), 6) as depth from windows group by sample")
def window_files(spark, d):
    """Coverage windows through gzip files."""
    path = _text(v.windows(spark, d), _tabs("chrom", "start", "end", "depth"), new_folder(spark, "windows"), ".gz", "gzip")
    rows = readers.read_windows(spark, path)
    return rounded(rows.groupBy("sample").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bp"), F.sum("depth").alias("depth")))


@query("select sample, chrom, count(*) as n, sum(pos)::bigint as pos from calls where code <> 'ref' group by all")
def site_files(spark, d):
    """The sparse site table, written by chromosome and read back."""
    path = new_folder(spark, "sites")
    writers.write_sites(v.calls(spark, d).select("sample", "chrom", "pos", "locus", "code"), path)
    return writers.read_sites(spark, path).groupBy("sample", "chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("pos"))


@query("select sample, chrom, count(*) as n from calls group by all")
def call_files(spark, d):
    """Calls written in a folder for each sample and read back."""
    path = new_folder(spark, "calls")
    writers.write_calls(v.calls(spark, d), path)
    return spark.read.schema("sample long, chrom string").parquet(path).groupBy("sample", "chrom").agg(F.count("*").alias("n"))


@query("select sample::varchar as sample, 'M' || (sample % 3) as instrument, '' || (sample % 5) as run, 'FC' || (sample % 2) as flowcell, (sample % 5) || '_FC' || (sample % 2) as run_flowcell from samples")
def fastq_names(spark, d):
    """Sequencing batches from the first read name of gzip files."""
    s = F.col("sample")
    name = F.concat(F.lit("@M"), s % 3, F.lit(":"), s % 5, F.lit(":FC"), s % 2, F.lit(":1:2:3:4 1:N\nACGT\n+\nIIII\n@other:1\n"))
    files = writers.write_texts(v.samples(spark, d).select("sample", name.alias("value")), new_folder(spark, "fastq"), ".fastq.gz")
    return readers.read_seq_batch(spark, files)


@query("select 's' || sample as patient, 's' || sample as sample, 1 as lane, '/d/x_s' || sample || '_R1.fastq.gz' as fastq_1, '/d/x_s' || sample || '_R2.fastq.gz' as fastq_2 from samples where sample % 10 <> 4")
def sample_sheet(spark, d):
    """Pairs of read files of known samples; every tenth sample has no mate."""
    s = v.samples(spark, d)
    both = s.select("sample", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("read")).filter("read = '1' or sample % 10 <> 4")
    paths = both.select(F.concat(F.lit("/d/x_s"), F.col("sample").cast("string"), F.lit("_R"), "read", F.lit(".fastq.gz")).alias("path"))
    return readers.build_samplesheet(paths, known=s.select(F.concat(F.lit("s"), F.col("sample").cast("string")).alias("sample")))
