"""Helpers shared by the operators: scratch tables, row keys, label samples.

Intermediate results go to Parquet folders below the shared checkpoint folder
(``spark.checkpoint.dir``), never to a machine-local folder: a task that is
run again after an executor loss reads the same written rows, and both sides
of a join on two written tables are plain shuffles, which adaptive execution
can split when one key holds a third of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(text_col: str) -> Column:
    """SHA-256 of the raw text; with the id it names a row for ``keep_rows``."""
    return F.sha2(text_or_empty(text_col).cast("binary"), 256)


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` named by ``kept`` (id_col, _row_key), one row each.

    Rows that repeat both id and text are one document; one of them stays.
    The text moves once, on the unique key (id, row key), so no key is hot."""
    key = lambda: F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    left = docs.select(F.struct("*").alias("_doc"), key().alias("_id_key"),
                       row_key(text_col).alias("_row_key"))
    right = kept.select(key().alias("_id_key"), "_row_key")
    return (left.join(right, ["_id_key", "_row_key"], "left_semi")
            .dropDuplicates(["_id_key", "_row_key"]).select("_doc.*"))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds`` (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def label_sample(labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """(doc_id, label) of at most ``bound`` labelled rows outside the held-out
    fold, those with the smallest id hashes: a bounded table, safe to broadcast.
    Of several labels of one document the largest counts; null labels don't."""
    rows = written(labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()
                                & (fold("doc_id", folds) != held_out))
                   .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")),
                   "usable-labels")
    return bounded_sample(rows, ["doc_id"], bound, rows.count())


def bounded_sample(rows: DataFrame, key: list[str], bound: int, about: int) -> DataFrame:
    """The at most ``bound`` rows with the smallest hashes of ``key``.  ``about``, the
    number of ``rows`` themselves (a larger one would leave too few), thins them
    out by hash first, so that tasks don't each send ``bound`` rows to the one
    that picks."""
    at = F.abs(F.xxhash64(*key) / float(1 << 63))
    if about > 4 * bound:
        rows = rows.where(at < 4 * bound / about)
    return rows.orderBy(at, *key).limit(bound)


def labelled_rows(docs: DataFrame, sample: DataFrame, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, label, text, name) of the documents in a bounded label sample, written: one row for
    each id and text, and of those at most ``bound``, with the smallest hashes.  So rows that
    repeat, or any number of texts under one labelled id, don't add to what a model is fitted
    on.  ``name`` is unique, to put rows in the same order in every run."""
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), row_key(text_col).alias("_key"))
        .join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "_key"]), "labelled-rows")
    n = rows.count()
    if n > bound:
        key = ["doc_id", "_key"]
        rows = rows.join(F.broadcast(bounded_sample(rows.select(*key), key, bound, n)), key, "left_semi")
    return rows.select("doc_id", "label", "text", F.concat_ws(":", F.col("doc_id").cast("string"), "_key").alias("name"))
