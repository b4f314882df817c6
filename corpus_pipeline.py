"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, personal data, encoding.

Each stage takes the rows that its predecessor kept. Columns of documents other than doc_id and
text travel packed in one struct, so that none can clash with an operator's own; text is held once.
Stages take null ids and texts, empty and very long texts, repeated rows and empty tables; what
becomes of them stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.llm.decontam import contaminated
from lociforge.llm.pii import masked, with_spans
from lociforge.llm.quality import measured, verdicts
from lociforge.llm.queries import tokenizer_file
from lociforge.llm.sentencepiece import encoded
from lociforge.llm.shared import staged, table, table_if_any
from lociforge.llm.similar import one_of_similar

MODEL = "piece_bpe_32k.model"


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns of docs in the struct _row."""
    other = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*other or [F.lit(True).alias("_none")]).alias("_row"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, from rows of _packed(docs)."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_row")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts are rejected, repeated rows are judged alike.

    A bounded sample of the documents in labels, where there are some, is part of the estimate.
    """
    rows = staged(measured(_packed(docs)), "measured")  # the votes are counted before any verdict
    return _unpacked(verdicts(rows, labels=table_if_any(spark, sf_dir, "labels")).filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (4/5 of all shingles of five words alike) the document with the smallest doc_id.

    Null and empty texts are alike; of repeated rows one stays; a group without ids keeps one row.
    """
    return _unpacked(one_of_similar(_packed(docs)), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; those without words stay, and so do all if the benchmark is empty."""
    rows = contaminated(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(rows.filter(F.size("hits.starts") == 0), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows the text.

    Null texts stay null; ids don't matter.
    """
    rows = _unpacked(masked(with_spans(_packed(docs))), docs)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, whose text decoding them gives back; null and empty texts have none."""
    return encoded(docs.select("doc_id", "text"), tokenizer_file(MODEL))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("encoding", encoding),
]
#: SQL can't express the fingerprints or the tokenizer; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; of an empty table nothing."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
