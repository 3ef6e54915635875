"""Resumable incremental harvest over a stream of fetched pages.

* R1: ``readStream`` (file source, explicit schema, ``maxFilesPerTrigger``)
  -> ``foreachBatch``: allowed hosts (F2) -> first page of each URL not seen
  before -> main text -> gates -> dedup against the history -> samples.
* R2: seen URLs are a key history (sources/history.py), not keyed state: of the rows of a URL
  the smallest page id of the first batch wins, and nothing grows on the executors' heap.
* R3: the dedup index is a key history too and survives restarts.  Of both histories a batch
  opens only the parts whose filter holds one of its own keys.
* Batch N reads what batches ``< N`` wrote and overwrites its own part, so a replayed
  batch is idempotent; samples and discovered links (allowed, F9, and not seen, J1) are
  written the same way, exactly once.  With ``jsonl`` the samples are appended as
  JSON lines as well, each batch visible by its manifest (sources/samples_io.py).
* A3/P1: ``decisions`` says of every page of a batch what became of it: ``no_url``,
  ``not_allowed``, ``seen`` (its URL came in an earlier batch), ``repeated`` (its URL has an
  earlier page in the batch), a gate's reason, ``duplicate`` or ``kept``.
* R4: the per-micro-batch commit of the streaming checkpoint.
All tables are read by an explicit schema: a batch may write no rows at all.
Processing order inside a batch (for first-wins dedup) is ``page_id``, null ids last.  Rows that
repeat page id and URL are one page.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.samples import instruction, source_tag
from ..functions.url import netloc, with_url_join
from ..operators.chunk import chunk
from ..operators.dedup import explode_bands, greedy_dedup_sigs
from ..operators.links import domain_allowed, not_visited, prepare_domains, resolved
from ..params import HarvestParams
from ..plans.crawl import page_rows
from ..session import ensure_checkpoint_dir, materialise, path_exists, spread
from ..sources.history import KeyHistory
from ..sources.samples_io import append_batch

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
#: stands for a null page id, so that it comes last and can be joined
LAST = (1 << 63) - 1
SINKS = {
    "samples": "url string, chunk_no long, instruction string, input string, output string",
    "discovered_links": "page_url string, link_pos int, link string",
    "decisions": "page_id long, url string, gate_reason string, n_samples long",
}


def read_sink(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """A table of the stream with its ``batch_id``; no rows before the first batch."""
    schema = SINKS[table] + ", batch_id long"
    path = os.path.join(out_dir, table)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_samples_sink(spark: SparkSession, out_dir: str) -> DataFrame:
    return read_sink(spark, out_dir, "samples")


def process_batch(batch: DataFrame, batch_id: int, out_dir: str, p: HarvestParams = HarvestParams(),
                  domains: DataFrame | None = None, jsonl: str | None = None) -> None:
    spark = batch.sparkSession
    seen = KeyHistory(spark, os.path.join(out_dir, "seen_urls"), "url string")
    kept_buckets = KeyHistory(spark, os.path.join(out_dir, "kept_buckets"), "band int, bkey string")

    def write(df: DataFrame, table: str) -> DataFrame:
        path = os.path.join(out_dir, table, f"batch_id={batch_id}")
        df.select(*T._parse_datatype_string(SINKS[table]).fieldNames()).write.mode("overwrite").parquet(path)
        return spark.read.schema(SINKS[table]).parquet(path)

    pages = batch.select(F.coalesce("page_id", F.lit(LAST)).alias("page_id"), "url", "html")
    allowed = prepare_domains(domains) if domains is not None else None
    # which row of a URL is taken is decided on narrow rows: one for each URL
    urls = pages.where("url IS NOT NULL").groupBy("url").agg(F.min("page_id").alias("_first"))
    if allowed is not None:
        urls = urls.withColumn("_netloc", netloc(F.col("url"))).join(
            allowed.withColumn("_allowed", F.lit(True)), "_netloc", "left").drop("_netloc")
    else:
        urls = urls.withColumn("_allowed", F.lit(True))
    urls = materialise(urls, "batch-urls")
    old = seen.may_match(urls.select("url"), batch_id).distinct()
    urls = materialise(urls.join(old.withColumn("_seen", F.lit(True)), "url", "left"), "batch-urls")
    first = materialise(urls.where("_allowed AND _seen IS NULL").select("url", F.col("_first").alias("page_id")),
                        "first-pages")
    rows = pages.join(first, ["url", "page_id"], "left_semi").dropDuplicates(["url", "page_id"])
    rows = materialise(page_rows(spread(rows), p), "batch-pages")
    passed = rows.where("gate_reason = 'pass'")
    sigs = passed.select(F.col("url").alias("_id"), F.col("page_id").alias("_ord"), "_dig", "_bkeys")
    own_keys = explode_bands(sigs).select(F.col("_band").alias("band"), F.col("_bkey").alias("bkey"))
    verdict, buckets = greedy_dedup_sigs(sigs, prior_buckets=kept_buckets.may_match(own_keys, batch_id), with_buckets=True)
    keep = materialise(verdict.where("keep").select(F.col("_id").alias("url")), "batch-kept")
    kept = passed.join(keep, "url", "left_semi")
    chunks = chunk(kept.select("url", "text"), "text", p, keep=["url"])
    samples = write(chunks.select(
        "url", "chunk_no",
        instruction(F.col("url"), F.col("chunk_no"), netloc(F.col("url")), p.templates,
                    p.seed).alias("instruction"),
        source_tag(F.col("url")).alias("input"), F.col("chunk").alias("output")), "samples")
    if jsonl:
        append_batch(samples, jsonl, batch_id)
    kept_buckets.write(batch_id, buckets)
    raw = kept.select(F.col("url").alias("_base"), F.posexplode("hrefs").alias("link_pos", "_href"))
    links = resolved(with_url_join(raw, "_base", "_href", "link").select("_base", "link_pos", "link"))
    if allowed is not None:
        links = domain_allowed(links, "link", allowed)
    asked = links.select(F.col("link").alias("url"))
    links = not_visited(not_visited(links, "link", seen.may_match(asked, batch_id)), "link", first)
    write(links.withColumnRenamed("_base", "page_url"), "discovered_links")
    # A3: every page of the batch, by joins of narrow written rows
    decided = materialise(rows.select("url", "page_id", "gate_reason", "_nchunks").join(
        keep.withColumn("_kept", F.lit(True)), "url", "left"), "batch-decided")
    every = materialise(pages.select("page_id", "url").distinct(), "batch-all")
    said = every.join(urls, "url", "left").join(decided, ["url", "page_id"], "left")
    reason = (F.when(F.col("url").isNull(), F.lit("no_url")).when(F.col("_allowed").isNull(), F.lit("not_allowed"))
              .when(F.col("_seen"), F.lit("seen")).when(F.col("page_id") != F.col("_first"), F.lit("repeated"))
              .when(F.col("gate_reason") != "pass", F.col("gate_reason"))
              .when(F.col("_kept"), F.lit("kept")).otherwise(F.lit("duplicate")))
    write(said.select(F.nullif("page_id", F.lit(LAST)).alias("page_id"), "url", reason.alias("gate_reason"),
                      F.when(F.col("_kept"), F.col("_nchunks")).otherwise(F.lit(0).cast("bigint")).alias("n_samples")),
          "decisions")
    seen.write(batch_id, first.select("url"))


def decision_report(spark: SparkSession, out_dir: str) -> DataFrame:
    """A3 of the stream: (batch_id, gate_reason, n) of all batches so far."""
    return read_sink(spark, out_dir, "decisions").groupBy("batch_id", "gate_reason").agg(F.count(F.lit(1)).alias("n"))


def start_incremental_harvest(spark: SparkSession, pages_dir: str, out_dir: str,
                              p: HarvestParams = HarvestParams(),
                              max_files_per_trigger: int = 1,
                              available_now: bool = True,
                              file_glob: str | None = None,
                              domains: DataFrame | None = None,
                              jsonl: str | None = None, schema: T.StructType = PAGE_SCHEMA):
    """Start the stream over the page files of ``pages_dir`` (optionally only
    names matching ``file_glob``); returns the StreamingQuery.  ``domains`` is the
    allow-list (domain); without it every host is allowed.  ``jsonl`` is a folder for the
    samples as JSON lines; ``schema`` may have html in bytes."""
    ensure_checkpoint_dir(spark)
    reader = (spark.readStream.schema(schema)
              .option("maxFilesPerTrigger", max_files_per_trigger))
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    writer = (reader.parquet(pages_dir).writeStream
              .foreachBatch(lambda df, bid: process_batch(df, bid, out_dir, p, domains, jsonl))
              .option("checkpointLocation", os.path.join(out_dir, "_stream_checkpoint")))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
