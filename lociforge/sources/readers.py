"""Readers of the text formats of target-capture work; every one reads whole folders or globs."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociforge.functions.genotypes import short_sample
from lociforge.operators.stored import stored
from lociforge.sources import schemas


def _sample(suffix: str, key: str = "sample") -> Column:
    """The sample of a file: its name without suffix, then the text after the last underscore; of a file in a folder sample=... that."""
    return _sample_of(F.col("_metadata.file_path"), suffix, key)


def _sample_of(path: Column, suffix: str, key: str = "sample") -> Column:
    folder = F.url_decode(F.regexp_extract(path, f"/{key}=([^/]*)/", 1))
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(folder != "", folder).otherwise(short_sample(F.regexp_replace(F.url_decode(name), rf"{suffix}$", "")))


def file_system(uri: str) -> tuple:
    """The client for a file's or folder's path as Spark and Hadoop print it (names are not decoded), and the path in it."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":/")
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest[1:] if rest.startswith('/') else f'/{rest}', safe='/:@')}")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts of the files in tables of paths, some MB at a time."""

    def batch(paths: list[str], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "value"])

    for part in batches:
        paths, texts, size = [], [], 0
        for path in part["path"].to_pylist():
            store, place = file_system(path)
            with store.open_input_stream(place, compression="gzip" if place.endswith(".gz") else None) as stream:
                texts.append(stream.read().decode("utf-8", "replace"))
            paths.append(path)
            size += len(texts[-1])
            if size > 4 << 20:
                yield batch(paths, texts)
                paths, texts, size = [], [], 0
        yield batch(paths, texts)


def _whole(spark: SparkSession, files: str | DataFrame, suffix: str) -> DataFrame:
    """(value, sample) of each file: of a path or glob, or of a table (path), whose files tasks open without any list of them in the driver."""
    if isinstance(files, DataFrame):
        return files.select("path").mapInArrow(_contents, "path string, value string").select("value", _sample_of(F.col("path"), suffix).alias("sample"))
    return spark.read.text(files, wholetext=True).select(F.col("value"), _sample(suffix).alias("sample"))


def _list(values: Column) -> Column:
    return F.filter(F.split(values, ","), lambda x: x != ".")


def read_vcf(spark: SparkSession, path: str, suffix: str = r"\.vcf(\.gz)?") -> DataFrame:
    """Raw calls of single-sample VCF files; the sample is the file's name. Header lines are skipped."""
    lines = spark.read.text(path).select("value", _sample(suffix).alias("sample")).filter(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    f = F.split("value", "\t")
    rows = lines.select(
        "sample", f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[3].alias("ref"), _list(f[4]).alias("alt"),
        f[5].try_cast("double").alias("qual"), F.filter(F.split(f[6], ";"), lambda x: ~x.isin(".", "PASS")).alias("filter"),
        F.arrays_zip(F.split(f[8], ":").alias("key"), F.split(f[9], ":").alias("value")).alias("_pairs"),
    )
    field = lambda key: F.get(F.filter("_pairs", lambda p: p["key"] == key), F.lit(0))["value"]
    gt = F.transform(F.split(field("GT"), "[/|]"), lambda x: x.try_cast("int"))
    ao = F.transform(F.split(field("AO"), ","), lambda x: x.try_cast("int"))
    return rows.select(
        "sample", "chrom", "pos", "ref", "alt", "qual", "filter", gt.alias("gt"),
        field("DP").try_cast("int").alias("dp"), field("GQ").try_cast("double").alias("gq"), field("RO").try_cast("int").alias("ro"), ao.alias("ao"),
    )


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True, null: str = "NA") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=header, nullValue=null, comment=None)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.LOCI, header=False, null="")


def read_fasta(spark: SparkSession, path: str, suffix: str = r"\.fa(sta)?(\.gz)?", key: str = "sample") -> DataFrame:
    """(sample, locus, seq): file and record of each sequence; white space inside is dropped. key: of a folder key=... that names its files.

    Records begin with ``>`` at the start of a line; one that stands elsewhere belongs to the header. A record is one
    value: for chromosomes see read_fasta_runs.
    """
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"), _sample(suffix, key).alias("sample"))
    records = records.filter(F.trim("value") != "")
    parts = F.split("value", "\n", 2)
    return records.select("sample", F.trim(parts[0]).alias("locus"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


_RUNS = "sample string, file string, block long, segment int, header string, at long, seq string"


def _runs(run: int):
    """Joins the lines of each block of a file to runs of letters; a record that began in an earlier block has no header."""

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, header, segment, at, held, size = None, None, 0, 0, [], 0

        def row(final: bool):
            nonlocal at, held, size
            text = "".join(held)
            rows = [(*place, segment, header, at + k, text[k : k + run]) for k in range(0, len(text) if final else len(text) - len(text) % run, run)]
            if final and not text and at == 0:
                rows = [(*place, segment, header, at, "")]
            done = sum(len(r[-1]) for r in rows)
            at, held = at + done, [text[done:]]
            size = len(held[0])
            return rows

        for part in parts:
            out = []
            for sample, file, block, line in part.itertuples(index=False):
                if (sample, file, block) != place:
                    out += row(True) if place else []
                    place, header, segment, at, held, size = (sample, file, block), None, 0, 0, [], 0
                if line.startswith(">"):
                    out += row(True)
                    header, segment, at, held, size = line[1:].strip(), segment + 1, 0, [], 0
                else:
                    line = "".join(line.split())
                    held.append(line)
                    size += len(line)
                    if size >= 4 * run:
                        out += row(False)
            if out:
                yield pd.DataFrame(out, columns=[f.split()[0] for f in _RUNS.split(", ")])
        if place:
            yield pd.DataFrame(row(True), columns=[f.split()[0] for f in _RUNS.split(", ")])

    return join


def read_fasta_runs(spark: SparkSession, path: str, suffix: str = r"\.fa(sta)?(\.gz)?", run: int = 1_000_000, key: str = "sample") -> DataFrame:
    """(sample, locus, start, seq): the sequences of FASTA files in runs of at most ``run`` letters, at start (from 0) of their record.

    Files are read in blocks, by as many tasks as they have; which record a block goes on with and at which
    letter comes from the blocks before it, a row each. A record without letters has one empty run; lines before the first header are an error.
    """
    lines = spark.read.text(path).select(_sample(suffix, key).alias("sample"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    runs = stored(lines.mapInPandas(_runs(run), _RUNS), "runs")
    ends = F.struct("segment", "at")
    blocks = runs.groupBy("file", "block").agg(F.max_by("header", ends).alias("last"), F.max_by(F.col("at") + F.length("seq"), ends).alias("n"))
    w = Window.partitionBy("file").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "_since").orderBy("block")  # a block and those it goes on from
    blocks = blocks.withColumns({"carried": F.last("last", ignorenulls=True).over(before), "_since": F.count("last").over(w)})
    blocks = blocks.withColumn("_upto", F.sum("n").over(upto)).withColumn("had", F.coalesce(F.lag("_upto").over(w), F.lit(0)))
    rows = runs.join(blocks.select("file", "block", "carried", "had"), ["file", "block"])
    rows = rows.filter(F.col("header").isNotNull() | (F.length("seq") > 0))
    locus = F.coalesce("header", "carried", F.raise_error(F.concat(F.lit("letters before the first header of "), F.col("file"))).cast("string"))
    return rows.select("sample", locus.alias("locus"), (F.col("at") + F.when(F.col("header").isNull(), F.col("had")).otherwise(0)).alias("start"), "seq")


def read_hits(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return read_tsv(spark, path, schemas.HITS, header=header)


def read_per_sample(spark: SparkSession, path: str, schema: str, suffix: str, header: bool = True) -> DataFrame:
    """Tables of one sample each as one, with the sample from the file's name."""
    return read_tsv(spark, path, schema, header).select(_sample(suffix).alias("sample"), "*")


def read_optional(read, *args, columns: str, spark: SparkSession, **kwargs) -> DataFrame:
    """What read gives; if its path does not exist, an empty table of ``columns``."""
    try:
        return read(spark, *args, **kwargs)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], columns)


def read_ids(spark: SparkSession, path: str, column: str = "sample") -> DataFrame:
    """One ID a line; blank lines are dropped, a missing file is an empty list."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{column} string")
    return lines.select(F.trim("value").alias(column)).filter(F.col(column) != "")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.META)


#: The keys of a mapping summary and the columns they become.
STATS = {
    "raw total sequences": "n_reads", "reads mapped": "n_mapped", "reads properly paired": "n_paired", "reads MQ0": "n_mq0",
    "error rate": "error_rate", "insert size average": "insert_size",
}


def read_mapping_stats(spark: SparkSession, path: str, suffix: str = r"\..*") -> DataFrame:
    """Per sample the values of SN lines whose keys are in STATS."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"), _sample(suffix).alias("sample")).filter(F.get("f", F.lit(0)) == "SN")
    rows = lines.select("sample", F.regexp_replace(F.get("f", F.lit(1)), ":$", "").alias("key"), F.get("f", F.lit(2)).try_cast("double").alias("value"))
    wide = rows.groupBy("sample").pivot("key", list(STATS)).agg(F.first("value"))
    return wide.select("sample", *[F.col(f"`{k}`").alias(c) for k, c in STATS.items()])


def with_rates(stats: DataFrame) -> DataFrame:
    pct = lambda c: F.coalesce(F.try_divide(100 * F.col(c), F.col("n_reads")), F.lit(0.0))
    return stats.withColumns({"pct_mapped": pct("n_mapped"), "pct_paired": pct("n_paired"), "pct_mq0": pct("n_mq0")})


def read_duplication(spark: SparkSession, path: str | DataFrame, suffix: str = r"\..*") -> DataFrame:
    """Per sample the percentage in the ninth field of the row after the LIBRARY header."""
    whole = _whole(spark, path, suffix)
    row = F.regexp_extract("value", r"(?m)^LIBRARY\t[^\n]*\n([^\n]*)", 1)
    return whole.select("sample", (100 * F.get(F.split(row, "\t"), F.lit(8)).try_cast("double")).alias("pct_duplication"))


def read_depth_summary(spark: SparkSession, path: str | DataFrame, suffix: str = r"\..*") -> DataFrame:
    """Per sample the genome's mean depth: bases by length of the row named total."""
    fields = "chrom string, length long, bases long"
    if isinstance(path, DataFrame):
        rows = _whole(spark, path, suffix).select("sample", F.posexplode(F.split("value", "\r?\n")).alias("_line", "value")).filter("_line > 0")
        rows = rows.select("sample", F.from_csv("value", fields, {"sep": "\t"}).alias("f")).select("sample", "f.*").filter("chrom = 'total'")
    else:
        rows = spark.read.schema(fields).csv(path, sep="\t", header=True)
        rows = rows.select("*", _sample(suffix).alias("sample")).filter("chrom = 'total'")
    return rows.select("sample", F.coalesce(F.try_divide("bases", "length"), F.lit(0.0)).alias("genome_dp"))


def read_windows(spark: SparkSession, path: str, suffix: str = r"\..*", partitions: int | None = None) -> DataFrame:
    """Coverage windows; gzip files can't be split, so their rows are dealt anew by sample and chromosome."""
    rows = read_per_sample(spark, path, schemas.WINDOWS, suffix, header=False)
    return rows.repartition(partitions, "sample", "chrom") if partitions else rows.repartition("sample", "chrom")


def read_flagstat(spark: SparkSession, path: str | DataFrame, suffix: str = r"\..*") -> DataFrame:
    whole = _whole(spark, path, suffix)
    return whole.select("sample", F.regexp_extract("value", r"(\d+) \+ \d+ primary mapped", 1).try_cast("long").alias("n_primary_mapped"))


def _first_names(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        lines = []
        for path in part["path"]:
            store, place = file_system(path)
            with store.open_input_stream(place, compression="gzip" if place.endswith(".gz") else None, buffer_size=1 << 16) as stream:
                data = b""
                while b"\n" not in data and (more := stream.read(1 << 12)):
                    data += more
            lines.append(data.split(b"\n")[0].decode().strip())
        yield pd.DataFrame({"sample": part["sample"], "name": lines})


def read_seq_batch(spark: SparkSession, path: str | DataFrame, suffix: str = r"[_.]R?1?.*") -> DataFrame:
    """(sample, instrument, run, flowcell, run_flowcell) from the first read name of each FASTQ file.

    path: a path or glob, or a table (path) of files, of which the driver then makes no list. Only the head of each file is read, in tasks.
    A file without reads, or a name with under seven fields, fails; files of no bytes at all are not listed by Spark and have no row.
    """
    files = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)
    files = files.select(_sample_of(F.col("path"), suffix).alias("sample"), "path")
    names = files.mapInPandas(_first_names, "sample string, name string")
    f = F.split(F.regexp_replace("name", "^@", ""), ":")
    checked = F.when(F.size(f) >= 7, f).otherwise(F.raise_error(F.concat(F.lit("read name with under 7 fields: "), F.col("name"))))
    return names.select("sample", checked.alias("f")).select(
        "sample", F.col("f")[0].alias("instrument"), F.col("f")[1].alias("run"), F.col("f")[2].alias("flowcell"),
        F.concat_ws("_", F.col("f")[1], F.col("f")[2]).alias("run_flowcell"),
    )


def build_samplesheet(paths: DataFrame, known: DataFrame | None = None, lane: int = 1) -> DataFrame:
    """(patient, sample, lane, fastq_1, fastq_2) of read pairs in paths (path); names end in _R1/_R2 or _1/_2.

    Files without their mate are left out. A sample with several files of one read fails, and so does one that is
    not in known (sample), where that is given.
    """
    name = F.element_at(F.split("path", "/"), -1)
    pattern = r"^(.*?)_R?([12])(?:_001)?\.f(?:ast)?q(?:\.gz)?$"
    rows = paths.select("path", short_sample(F.regexp_extract(name, pattern, 1)).alias("sample"), F.regexp_extract(name, pattern, 2).alias("read"))
    of = lambda r: F.when(F.col("read") == r, F.col("path"))
    pairs = rows.filter("sample <> ''").groupBy("sample").agg(*[f(of(r)).alias(f"{n}_{r}") for r in "12" for n, f in (("fastq", F.max), ("n", F.count))])
    wrong = F.raise_error(F.concat(F.lit("several files of one read: "), F.col("sample"))).cast("string")
    pairs = pairs.withColumn("sample", F.when(F.greatest("n_1", "n_2") > 1, wrong).otherwise(F.col("sample"))).filter("n_1 > 0 and n_2 > 0")
    if known is not None:
        pairs = pairs.join(known.select(F.col("sample").alias("_known")).distinct(), F.col("sample") == F.col("_known"), "left")
        unknown = F.raise_error(F.concat(F.lit("sample without metadata: "), F.col("sample"))).cast("string")
        pairs = pairs.withColumn("sample", F.when(F.col("_known").isNull(), unknown).otherwise(F.col("sample")))
    return pairs.select(F.col("sample").alias("patient"), "sample", F.lit(lane).alias("lane"), "fastq_1", "fastq_2")
