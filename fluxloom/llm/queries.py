"""The registered queries of the thirteen operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chroma, decontaminate, divergence, forest, html, merkle, oracles, simhash, tokenfiles, toxicity, warc
from .common import table


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.read_back(chat.windows(turns.unionByName(added)))


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors played as recordings; queries are the rows whose id is divisible by 50."""
    media = chroma.as_media(table(spark, sf_dir, "embeddings"))
    return chroma.search(media, lambda i: i % 50 == 0).withColumnRenamed("id", "vec_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, differ=4)


def op4_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_counts(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.write_and_read(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 50."""
    return forest.neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_chat_windows, op2_chroma_fingerprints, op3_simhash, op4_separator_scan, op5_token_files, op6_main_text, op7_toxicity, op8_decontamination, op9_bpe, op10_warc, op11_source_divergence, op12_projection_forest, op13_merkle_manifest)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """Those of counts and digests; codecs, tokens, alignments and models are beyond SQL, and tests/llm has brute-force versions."""
    return {"op11_source_divergence": oracles.DIVERGENCE, "op13_merkle_manifest": oracles.MERKLE}
