"""The queries of the text operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, conversations, decontaminate, licenses, line_dedup, lm, near, pii, quality, rules, secrets, token_counts, whitening
from plumbline.llm.texts import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"])


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents"), ["doc_id"]))


@_query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode_and_decode(table(spark, sf_dir, "documents"), ["doc_id"])
    return made.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@_query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"), ["doc_id"])


@_query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), quality.remainder(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held)
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), quality.score(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@_query
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score_texts(docs, quality.remainder(docs["doc_id"], 7) == 2)


@_query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents")).drop("row")


@_query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLES["op4_line_dedup"] = line_dedup.ORACLE


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])


ORACLES["op7_quality_rules"] = rules.ORACLE


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id")


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


ORACLES["op12_conversation_repair"] = conversations.ORACLE


@_query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
