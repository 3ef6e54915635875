"""Document harvest: gates -> greedy near-duplicate removal -> chunk fold ->
instruction samples, over a table of documents (no crawl).

The documents table plays the role of already-extracted page text: the
``source`` column is the topic and the sample ``input`` is ``Source: <source>``.
Processing order (for first-wins dedup) is ``doc_id``.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.samples import instruction, source_tag
from ..operators.chunk import chunk
from ..operators.gates import apply_gates, gate_reason
from ..functions.minhash import dedup_keys
from ..operators.dedup import greedy_dedup_sigs
from ..params import HarvestParams
from ..session import cut_lineage, materialise

log = logging.getLogger(__name__)

DOC_PARAMS = HarvestParams(sep="\n")


def samples_from_chunks(chunks: DataFrame, key: str, topic: str, source: str,
                        p: HarvestParams = HarvestParams()) -> DataFrame:
    """Chunk rows -> (key, chunk_no, instruction, input, output, source)."""
    return chunks.select(
        F.col(key), F.col("chunk_no"),
        instruction(F.col(key), F.col("chunk_no"), F.col(topic), p.templates, p.seed)
        .alias("instruction"),
        source_tag(F.col(source)).alias("input"),
        F.col("chunk").alias("output"), F.col(source).alias("source"),
    )


def document_reasons(docs: DataFrame, p: HarvestParams = DOC_PARAMS,
                     dedup: bool = True) -> DataFrame:
    """P1 for every document, narrow: (doc_id, source, gate_reason) with
    gate_reason in no_text / short / low_grade / duplicate / kept.

    One map-side pass over the text computes the gate reason and, for
    passing documents only, the token-set digest and LSH band keys; that
    narrow table is checkpointed and everything after it (exact-copy
    collapse, dedup rounds) runs on small rows only."""
    base = docs.select("doc_id", "source", "text").withColumn(
        "_reason", gate_reason(F.col("text"), p))
    if not dedup:
        return base.select("doc_id", "source", F.when(
            F.col("_reason") == "pass", F.lit("kept")).otherwise(F.col("_reason"))
            .alias("gate_reason"))
    ok = F.col("_reason") == "pass"
    text_ok = F.when(ok, F.col("text"))
    # live gate metrics (A3) collected by the same pass, no extra job
    obs = Observation("gates")
    base = base.observe(obs, *[F.count(F.when(F.col("_reason") == r, 1)).alias(r)
                               for r in ("no_text", "short", "low_grade", "pass")])
    keys = dedup_keys(text_ok, p.num_perm, p.bands, p.rows)
    narrow = cut_lineage(base.select(
        "doc_id", "source", "_reason", keys["digest"].alias("_dig"), keys["bkeys"].alias("_bkeys")))
    log.info("gate counts: %s", obs.get)
    sigs = narrow.where(ok).select(F.col("doc_id").alias("_id"), F.col("doc_id").alias("_ord"),
                                   "_dig", "_bkeys")
    verdict = greedy_dedup_sigs(sigs)
    return narrow.join(verdict.withColumnRenamed("_id", "doc_id"), "doc_id", "left").select(
        "doc_id", "source",
        F.when(F.col("_reason") != "pass", F.col("_reason"))
        .when(F.col("keep"), F.lit("kept")).otherwise(F.lit("duplicate")).alias("gate_reason"))


def document_samples(docs: DataFrame, p: HarvestParams = DOC_PARAMS,
                     dedup: bool = True) -> DataFrame:
    """documents -> gates -> (dedup) -> chunks -> samples."""
    if not dedup:
        kept = apply_gates(docs.select("doc_id", "text", "source"), "text", p)
    else:
        # a written id table: broadcast by AQE if its bytes are few, else a shuffle join
        ids = materialise(document_reasons(docs, p, dedup=True)
                          .where(F.col("gate_reason") == "kept").select("doc_id"), "kept-ids")
        kept = docs.select("doc_id", "text", "source").join(ids, "doc_id", "left_semi")
    chunks = chunk(kept, "text", p, keep=["doc_id", "source"])
    return samples_from_chunks(chunks, "doc_id", "source", "source", p)
