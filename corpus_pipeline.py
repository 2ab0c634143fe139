"""A training corpus from raw documents: quality, exact copies, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the last
returns token counts and digests. ``run`` applies them to the documents table, each on what the one before has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from ionloom.llm.queries import table, tokenizer
from ionloom.session import scratch_folder, ship_package


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects. It learns from the labelled documents that are not held out."""
    ship_package(spark)
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=quality.fold(F.col("doc_id"), 3) != 1)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))  # its own score column, if any, stays
    return quality.score(rows, model, "_text").where("predicted = 1").select("_row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the longest row of each group of equal texts."""
    ship_package(spark)
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of near copies."""
    ship_package(spark)
    return jaccard_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or an edited copy of one."""
    ship_package(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode, decode and digest what is left."""
    ship_package(spark)
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", without_benchmark),
    ("bpe", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; every result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = scratch_folder(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
