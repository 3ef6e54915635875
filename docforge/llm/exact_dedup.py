"""Exact deduplication by a tree merge of digest runs (DataFrame functions only).

1. One pass over the texts makes narrow rows: row number, id, SHA-256 of the
   normalised text (each run of ``[\\x20\\x09-\\x0D]`` becomes one space) and,
   to verify it, the text's byte length and an independent 64-bit hash.  The
   rows are written; each input partition is a run.
2. Binomial rounds: at each level 2**``fan_bits`` neighbouring runs are merged.
   Equal (digest, length, hash) keys of the merged runs meet, the smallest
   identifier and the row count stay.  Partial aggregation sorts and collapses
   each task's part before it is exchanged, so copies shrink level by level and
   a group with a third of all rows arrives as one row per task.
3. The last level holds one row per distinct text; it is written and joined to
   the narrow rows.  Both sides are written tables, so a hot digest is split.

Null texts count as empty.  Rows with a null id are dropped in favour of any
copy with an id; among rows that tie on the id the first written row stays, so
exactly one row of each group is kept.  No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, row_key, text_or_empty, written

WHITE_SPACE = r"[\x20\x09-\x0D]+"
KEY = ["text_sha256", "_bytes", "_check"]


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), WHITE_SPACE, " ")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written narrow rows (_row, _id, _row_key, text_sha256, _bytes, _check, _run)."""
    norm = docs.select(F.col(id_col).alias("_id"), row_key(text_col).alias("_row_key"),
                       normalised(text_col).alias("_norm"))
    return written(norm.select(
        F.monotonically_increasing_id().alias("_row"), "_id", "_row_key",
        F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("_norm").cast("bigint").alias("_bytes"),
        F.xxhash64("_norm").alias("_check"),
        F.spark_partition_id().alias("_run")), "digest-rows")


def tree_merge(rows: DataFrame, fan_bits: int = 4) -> DataFrame:
    """One row per distinct key: the smallest identifier ``_keep`` and ``group_size``."""
    runs = (rows.agg(F.max("_run")).first()[0] or 0) + 1
    level = rows.select(
        *KEY, "_run", F.lit(1).cast("bigint").alias("group_size"),
        F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"),
                 F.col("_row").alias("row")).alias("_keep"))
    while True:
        runs = (runs - 1 >> fan_bits) + 1
        level = level.groupBy(
            F.shiftright("_run", fan_bits).alias("_run"), *KEY).agg(
            F.sum("group_size").alias("group_size"), F.min("_keep").alias("_keep"))
        if runs == 1:
            return level.drop("_run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fan_bits: int = 4) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256, _row_key."""
    rows = digest_rows(docs, id_col, text_col)
    groups = written(tree_merge(rows, fan_bits), "digest-groups")
    return rows.join(groups, KEY).select(
        F.col("_id").alias(id_col), F.col("_keep.id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_keep.row")).alias("kept"), "text_sha256", "_row_key")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies, columns unchanged."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(id_col, "_row_key")
    return keep_rows(docs, kept, id_col, text_col)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).drop("_row_key")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
