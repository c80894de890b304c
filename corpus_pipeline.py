"""A corpus pipeline of four operators: toxicity, near-duplicates, benchmark leaks, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxloom.llm import bpe, common, decontaminate, simhash, toxicity
from fluxloom.session import ship


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade over 0 is at most one half; edge cases are those of ``toxicity.drop_toxic``."""
    ship(spark)
    model = toxicity.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash at 4 bits, or a Jaccard similarity of 0.8 of the shingles of five words.

    The second link is a method beside SimHash (see the README). Edge cases are those of ``simhash.drop_near_duplicates``.
    """
    ship(spark)
    return simhash.drop_near_duplicates(docs, words=5)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item; edge cases are those of ``decontaminate.drop_contaminated``."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the text decoded from them; edge cases are those of ``bpe.encode_decode``."""
    ship(spark)
    return bpe.encode_decode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", toxic_documents),
    ("simhash_and_similarity_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("bpe", token_ids),
]

#: Regression, SimHash, alignment and BPE are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written as Parquet and read again. An empty table passes through."""
    folder = common.shared_dir(spark)
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = common.stored(stage(spark, docs, sf_dir), folder, f"{k}-{name}")
    return docs
