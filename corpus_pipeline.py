"""A pipeline over the documents table: each stage calls one of the operators in plumbline.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each one's result is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents, in their order and types, whatever
further columns there are and however they are called.  Every stage takes empty tables and gives empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, line_dedup, near, quality
from plumbline.llm.texts import free_name, table
from plumbline.session import scratch_path

#: Scores below this are rejected; a document needs good evidence against it.
REJECT_BELOW = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, fitted on all labels, rejects.

    A null text counts as empty; equal texts have equal scores, so repeated rows stay or go together.  Without labels of both
    classes all documents stay, unless nearly all labels are 0.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    name = free_name(docs, "score")
    return docs.withColumn(name, quality.score(docs, model)).where(F.col(name) >= REJECT_BELOW).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that stand earlier in the corpus, and documents of which no visible text is left by that.

    n_chars, where there is such a column, follows the new text.  Null and empty texts stay as they are; a null id comes after
    all others; rows that repeat an id and a text are one document, whose rows all have its result.
    """
    counts = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    made = line_dedup.dedup_lines(docs, counts=counts)
    emptied = (F.col(counts[1]) > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    made = made.where(~emptied).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return made
    kind = dict(docs.dtypes)["n_chars"]
    return made.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one of least id.

    A group is all that links of 0.8 or more connect.  Null and empty texts are in no group and stay.  Where no document of a group has
    an id, one of them stays; of rows that repeat an id and a text one stays, any of them, whatever their other columns.
    """
    return near.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain benchmark items, or edited copies of them.

    Null and empty texts match nothing and stay; repeated rows stay or go together; null items are not sought.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts: doc_id, n_tokens, ids, and whether decoding gives the text again.

    A null text counts as empty and has no tokens; repeated rows give repeated results; other columns are left out.
    """
    name = free_name(docs, "text")
    made = bpe.encode_and_decode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias(name)), ["doc_id", name], name)
    return made.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.col(name)).alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", encode_stage),
]

#: The first and third to fifth stages have no SQL form; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder (and left there) and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage-{i}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
