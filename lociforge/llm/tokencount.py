"""Token counts of documents in flat files of ids without an index.

The files of a stream are read in blocks; in each block a vectorised comparison finds the
end-of-document ids. A prefix scan over the blocks of a stream (ids so far, documents so
far, place after the last end) stitches documents that cross blocks or files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lociforge.llm.wordcache import plain, slices, word_encoder

BLOCK = 1 << 18
_ENDS = T.StructType([
    T.StructField("stream", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("block", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
])


def write_stream(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text") -> None:
    """Writes the ids of docs (stream, place, text) as flat files of two-byte ids.

    Each document is followed by end_id; a stream's documents are in order of place, in a
    folder of its own. Rows stay in their partition: a stream is to be part of one partition
    (of several, its order is by file). Special tokens in a text are ordinary text, so end_id
    ends documents only; null and empty texts are an end_id alone. Where docs have a file_key,
    folders are named by it and the first place of the stream instead.
    """
    runs = "file_key" in docs.columns
    names = ["file_key", "first"] if runs else ["stream"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, special=False)
        first: dict[int, int] = {}  # of each stream, whose rows come in order of place
        for batch in batches:
            for part in slices(batch, text):
                ids, n = encoder(plain(part[text]))
                if len(ids) and int(ids.max()) >= 1 << 16:
                    raise ValueError("ids of two bytes cannot hold this vocabulary")
                data = ids.astype("<u2").tobytes()
                upto = np.concatenate([[0], 2 * np.cumsum(n)]).tolist()
                own = pa.array([data[a:b] for a, b in zip(upto, upto[1:], strict=False)], pa.binary())
                cols = [part["stream"]]
                if runs:
                    pairs = zip(part["stream"].to_pylist(), part["place"].to_pylist(), strict=True)
                    cols = [part["file_key"], pa.array([first.setdefault(s, p) for s, p in pairs], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, part["place"], own], [*names, "place", "ids"])

    schema = ", ".join(f"{x} long" for x in names) + ", place long, ids binary"
    rows = docs.select("stream", *names[:1] * runs, "place", text).mapInArrow(encode, schema)
    rows = rows.sortWithinPartitions(*names, "place").select(*names, F.col("ids").cast("string").alias("value"))
    end = end_id.to_bytes(2, "little").decode("latin-1")
    rows.write.partitionBy(*names).option("encoding", "ISO-8859-1").option("lineSep", end).option("compression", "gzip").text(path)


def ends_by_block(files: DataFrame, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """The places of end_id in each block of files (stream, path, content); .gz files are unpacked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, path, content in zip(batch["stream"].to_pylist(), batch["path"].to_pylist(), batch["content"], strict=True):
                data = content.as_buffer()
                ids = np.frombuffer(zlib.decompress(data, 31) if path.endswith(".gz") else data, f"<u{width}")
                runs = [ids[i : i + block] for i in range(0, len(ids), block)]
                cols = ([stream] * len(runs), [path] * len(runs), range(len(runs)), map(len, runs), [np.flatnonzero(r == end_id) for r in runs])
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], _ENDS.names)

    return files.select("stream", "path", "content").mapInArrow(scan, _ENDS)


def token_counts(files: DataFrame, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(stream, ordinal, start, n_tokens, ended) of each document of files (stream, path, content).

    start counts the stream's ids before it, ends included; n_tokens is without its end. Ids
    after the last end are a document with ended false. A stream without ids has no documents,
    two ends in a row have an empty one between them; files of one path count once for each row;
    other columns of files are left out; no files give no rows.
    """
    blocks = ends_by_block(files, end_id, width, block)
    w = Window.partitionBy("stream").orderBy("path", "block")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(past), F.lit(0)))
    blocks = blocks.withColumn("after", F.when(F.size("ends") > 0, F.col("base") + F.element_at("ends", -1) + 1))
    blocks = blocks.select(
        "stream", "base", "n", "ends",
        F.coalesce(F.max("after").over(past), F.lit(0)).alias("open"),
        F.coalesce(F.sum(F.size("ends")).over(past), F.lit(0)).alias("done"),
        F.lead("n").over(w).isNull().alias("last"),
    )
    last_end = F.coalesce(F.col("base") + F.try_element_at("ends", F.lit(-1)) + 1, F.col("open"))
    tail = F.when(F.col("last") & (last_end < F.col("base") + F.col("n")), F.array((F.col("base") + F.col("n")).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    ends = F.concat(F.transform("ends", lambda e: F.col("base") + e), tail)
    starts = F.concat(F.array("open"), F.transform("all", lambda e: e + 1))
    pairs = F.zip_with("all", F.slice(starts, F.lit(1), F.size("all")), lambda e, s: F.struct(e.alias("end"), s.alias("start")))
    rows = blocks.withColumn("all", ends).select("stream", "done", F.size("ends").alias("whole"), F.posexplode(pairs).alias("k", "at"))
    return rows.select(
        "stream", (F.col("done") + F.col("k")).alias("ordinal"), "at.start",
        (F.col("at.end") - F.col("at.start")).alias("n_tokens"), (F.col("k") < F.col("whole")).alias("ended"),
    )


def document_counts(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, stream, start, n_tokens) of docs (doc_id, text, stream, place[, file_key]), written to path and counted there.

    docs are read twice, for the texts and for the ids. With a file_key, (file_key, place) name a
    document and the streams may differ between the two; without, they must be the same. A
    document that isn't found fails the run. Null and empty texts have no tokens; doc_id may be null or
    repeated, and each row has a row; other columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", *[c for c in ("file_key", "stream", "place") if c in docs.columns])
    runs = "file_key" in docs.columns
    write_stream(docs, path, tokenizer, end_id)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    for name in ["file_key", "first"] if runs else ["stream"]:
        files = files.withColumn(name, (F.col(name) if name in files.columns else F.lit(None)).cast("long"))  # no rows, no folders
    if runs:
        files = files.withColumn("stream", F.xxhash64("file_key", "first"))
    counted = token_counts(files, end_id).withColumn("_found", F.lit(True))
    if runs:
        streams = files.select("stream", "file_key", "first").distinct()
        counted = counted.join(F.broadcast(streams), "stream").withColumn("place", F.col("first") + F.col("ordinal"))
        rows = docs.select("doc_id", "file_key", "place").join(counted, ["file_key", "place"], "left")
    else:
        order = Window.partitionBy("stream").orderBy("place")
        named = docs.select("doc_id", "stream", (F.row_number().over(order) - 1).cast("long").alias("ordinal"))
        rows = named.join(counted, ["stream", "ordinal"], "left")
    lost = F.raise_error(F.lit("a document is not in the files of its stream")).cast("long")
    return rows.select("doc_id", "stream", "start", F.when(F.col("_found"), F.col("n_tokens")).otherwise(lost).alias("n_tokens"))


def with_streams(docs: DataFrame) -> DataFrame:
    """doc_id and text of a Parquet table with file_key and place, which name a row of a file, and stream, a part of it that a task reads.

    Other columns of docs are left out, so their names may be any.
    """
    meta = docs.metadataColumn("_metadata")
    return docs.select(
        "doc_id", "text", F.xxhash64(meta["file_path"]).alias("file_key"),
        F.xxhash64(meta["file_path"], meta["file_block_start"]).alias("stream"), meta["row_index"].alias("place"),
    )
