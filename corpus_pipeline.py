"""A training-data pipeline in stages; each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.llm import bpe, contamination, lines, minhash, quality
from tablekeep.llm.queries import table, vocabulary
from tablekeep.session import materialize

ORACLE_SQL = None  # scores and BPE are beyond SQL; tests compare the stages with brute force


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold learned from labels."""
    return quality.drop_bad(docs, table(spark, sf_dir, "labels"))


def without_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents go from all texts; documents stay, n_chars follows the text."""
    kept = lines.clean_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles."""
    return minhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 or more of a benchmark item's five-word shingles go."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, text (decoded from the ids) and n_tokens of every document.

    The ids are stored in between: in one stage, every task would hold a Python worker for each of the two, and keep both.
    """
    encoded = materialize(bpe.encode(docs, vocabulary()), "pipeline-ids")
    return bpe.decode(encoded, vocabulary()).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("line_dedup", without_frequent_lines),
    ("near_dedup", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
