"""Exact duplicates by progressive refinement: length, then hash of a prefix, then hash of the whole text.

Texts are compared without ASCII white space. A first pass over the table writes three numbers per row (normalized
length, prefix hash, original length). Only lengths that occur twice go to the prefix step, only (length, prefix) pairs
that occur twice have their whole text hashed for grouping. Counts are summed map-side, so a hot group crosses the
shuffle as one row per task; the rows of a group meet its keeper in a join that adaptive execution can split.

Of equal texts the row with the most code points, then the smallest key, stays; a null key counts as smallest. Rows that
repeat a key and its text are kept once. Null text counts as empty, and empty texts equal each other. Other columns do
not take part. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm import textbatch as tb
from ionloom.session import cut_lineage, small_side

SPACES = " \t\n\x0b\x0c\r"
PREFIX_CHARS = 256


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalized text in UTF-8."""
    return F.sha2(normalized(text).cast("binary"), 256)


def _measured(docs: DataFrame, key: str, text: str, prefix: int) -> DataFrame:
    plain = normalized(F.col(text))
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), plain.alias("plain")).select(
        "key", "text", F.length("plain").alias("n"), F.xxhash64(F.substring("plain", 1, prefix)).alias("p"),
        F.length(F.coalesce("text", F.lit(""))).alias("chars"),
    )


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX_CHARS, with_digest: bool = True) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256 (null for lone rows without ``with_digest``)."""
    measured = _measured(docs, key, text, prefix)
    narrow = cut_lineage(measured.select("key", "n", "p"))
    lengths = small_side(narrow.groupBy("n").count().where("count > 1").select("n"))
    pairs = narrow.join(lengths, "n", "left_semi").groupBy("n", "p").count().where("count > 1").select("n", "p")
    pairs = small_side(pairs)
    surviving = measured.join(pairs, ["n", "p"], "left_semi")
    hashed = cut_lineage(surviving.select("key", "n", digest(F.col("text")).alias("text_sha256"), "chars"))
    groups = hashed.groupBy("n", "text_sha256").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("chars")).alias("c"), "key")).alias("best")
    ).where("group_size > 1").select(F.col("n").alias("gn"), F.col("text_sha256").alias("gs"), "group_size", F.col("best.key").alias("keep_id"))
    groups = cut_lineage(groups)
    rows = cut_lineage(hashed.groupBy("key", "n", "text_sha256").agg(F.count(F.lit(1)).alias("copies")))
    grouped = rows.join(groups, (F.col("n") == F.col("gn")) & (F.col("text_sha256") == F.col("gs")), "left").select(
        "key", F.when(F.col("gs").isNull(), F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).select("key", "keep_id", "group_size", (F.col("key").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    rest = measured if with_digest else narrow
    alone = rest.join(pairs, ["n", "p"], "left_anti").select(
        "key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        (digest(F.col("text")) if with_digest else F.lit(None).cast("string")).alias("text_sha256"),
    )
    return grouped.unionByName(alone).withColumnRenamed("key", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX_CHARS) -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    Keys may repeat: a row is told by key and digest, and of rows that repeat both the longest stays. Only rows whose key
    is marked (something to drop, or a repeat) are hashed and grouped; all others pass through one anti-join.
    """
    marked = duplicate_groups(docs, key, text, prefix, with_digest=False).where("group_size > 1").groupBy(
        F.col(key).alias("_k"), F.col("text_sha256").alias("_s")
    ).agg(F.max("kept").alias("_stays"), F.count(F.lit(1)).alias("_copies")).where("NOT _stays OR _copies > 1")
    marked = cut_lineage(marked)
    keys = small_side(marked.select("_k").distinct())
    other = tb.unused(docs, "_k")[0]
    rest = docs.join(keys.withColumnRenamed("_k", other), F.col(key).eqNullSafe(F.col(other)), "left_anti")
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), digest(F.col(text)).alias("_digest"),
                      F.length(F.coalesce(text, F.lit(""))).alias("_chars"))
    touched = row.join(keys, F.col("_key").eqNullSafe(F.col("_k")), "left_semi")
    dropped = small_side(marked.where("NOT _stays").select("_k", "_s"))
    again = touched.join(dropped, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_s")), "left_anti")
    again = again.groupBy("_key", "_digest").agg(F.max_by("_row", "_chars").alias("_row")).select("_row.*")
    return rest.unionByName(again)
