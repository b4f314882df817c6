"""Writers of results and of the sparse site table."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.operators.sequences import locus_file_names
from lociforge.operators.stored import stored
from lociforge.sources.readers import file_system


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, sep="\t", header=header, nullValue="NA")


def write_bed(loci: DataFrame, path: str) -> None:
    write_tsv(loci.select("chrom", "start", "end", "locus").orderBy("chrom", "start", "locus"), path, header=False)


def write_fasta_by_locus(seqs: DataFrame, path: str) -> None:
    """A folder for each locus, its records headed by sample."""
    rows = seqs.join(locus_file_names(seqs), "locus")
    records = rows.select("file_name", F.concat(F.lit(">"), F.col("sample").cast("string"), F.lit("\n"), "seq").alias("value"), "sample")
    records.repartition("file_name").sortWithinPartitions("file_name", "sample").select("file_name", "value").write.partitionBy("file_name").text(path)


def write_sites(sites: DataFrame, path: str) -> None:
    """The sparse site table, a folder for each chromosome, in order of locus and position."""
    rows = sites.filter("code <> 'ref'").repartition("chrom", "locus").sortWithinPartitions("chrom", "locus", "pos")
    rows.write.partitionBy("chrom").parquet(path)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_calls(calls: DataFrame, path: str) -> None:
    calls.repartition("sample").sortWithinPartitions("sample", "chrom", "pos").write.partitionBy("sample").parquet(path)


def write_vcf(calls: DataFrame, path: str) -> None:
    """Raw calls as VCF text, a folder for each sample; files are sorted by chromosome and position, each with a header."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("."))
    joined = lambda xs, sep: F.when(F.size(xs) > 0, F.array_join(F.transform(xs, text), sep)).otherwise(".")
    gt = F.when(F.col("gt").isNull(), "./.").otherwise(F.array_join(F.transform("gt", text), "/"))
    fields = F.concat_ws(":", gt, text(F.col("dp")), text(F.col("gq")), text(F.col("ro")), joined(F.col("ao"), ","))
    qual = F.regexp_replace(text(F.col("qual")), r"\.0$", "")
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", joined(F.col("alt"), ","), qual, joined(F.col("filter"), ";"), F.lit("."), F.lit("GT:DP:GQ:RO:AO"), fields)
    rows = calls.select("sample", "chrom", "pos", line.alias("value"))
    heads = calls.select("sample").distinct().select(
        "sample", F.lit("").alias("chrom"), F.lit(-1).cast("long").alias("pos"),
        F.concat(F.lit("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), F.col("sample").cast("string")).alias("value"),
    )
    rows = rows.unionByName(heads).repartition("sample").sortWithinPartitions("sample", "chrom", "pos", "value")
    rows.select("sample", "value").write.partitionBy("sample").text(path)


def write_texts(df: DataFrame, path: str, ending: str = "") -> DataFrame:
    """A file of text for each sample of df (sample, value), a line for each row, in a folder sample=...; returns the table (path) of the files.

    Tasks write the files themselves, through the file system's client, and the table of their paths is stored: no commit,
    listing or list of files in the driver grows with the samples. A task that runs again writes the same files. ending: .gz compresses.
    """
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, place), attempt = file_system(root), TaskContext.get().taskAttemptId()
        sample, stream, done = None, None, []

        def close() -> None:
            if stream:
                stream.close()
                store.move(f"{place}/{folder}/.{attempt}{ending}", f"{place}/{folder}/part-0{ending}")
                done.append(f"{root}/{folder}/part-0{ending}")

        for batch in batches:
            for name, line in zip(batch["sample"].to_pylist(), batch["value"].to_pylist(), strict=True):
                if stream is None or name != sample:
                    close()
                    sample, folder = name, f"sample={quote(name, safe='')}"
                    store.create_dir(f"{place}/{folder}")
                    stream = store.open_output_stream(f"{place}/{folder}/.{attempt}{ending}", compression="gzip" if ending.endswith(".gz") else None)
                stream.write(f"{line}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])
            done.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    name = F.coalesce(F.nullif(F.col("sample").cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))  # as Spark's writer names it
    rows = df.select(name.alias("sample"), F.coalesce("value", F.lit("")).alias("value")).repartition("sample").sortWithinPartitions("sample")
    return stored(rows.mapInArrow(write, "path string"), "files")
