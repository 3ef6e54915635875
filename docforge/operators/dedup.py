"""Near-duplicate removal: LSH buckets (J3) and greedy first-wins dedup.

Semantics: documents are visited in ``order``; a document is a duplicate iff
it shares an LSH bucket (band, key) with an earlier *kept* document.  A
dropped document never enters the index, so A~B, B~C, A!~C keeps A and C.

Spark plan (no pair is ever materialised, so a bucket holding a third of all
rows costs one partial aggregate, not a quadratic pair list):

1. exact copies: documents with the same token set have the same signature;
   all but the first (in order) are duplicates.  ``groupBy(digest).min(order)``
   (map-side partial aggregate) + join back.  Signatures are then computed
   only for the first copies.
2. bucket membership rows ``(id, order, band, key)``; buckets with one member
   are dropped (their documents are trivially kept).
3. rounds (greedy maximal independent set): per bucket the two first undecided
   documents; a document that is first in all of its buckets is kept, the other
   undecided documents of a kept one's buckets are dropped, and only rows of
   documents still undecided go on.  At least the first undecided document is
   decided per round, and the loop ends when none is left.
4. chains: a document with exactly one undecided earlier neighbour is that one's
   opposite.  These links form a forest; pointer doubling with parity finds the root of
   each in a number of joins that grows with the logarithm of the depth, and
   an even distance from a kept root is kept in the same round.  So a path of n near
   copies takes about log2(n) joins, not n / 2 rounds.

Member rows and bucket rows are written tables before they are joined, so a
bucket that holds a third of all rows is split by AQE (tests/test_skew.py).
A NULL text counts as the empty text.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.minhash import dedup_keys
from ..params import HarvestParams
from ..session import cut_lineage, materialise

log = logging.getLogger(__name__)


def doc_signatures(docs: DataFrame, id_col: str, order_col: str, text_col: str,
                   p: HarvestParams = HarvestParams()) -> DataFrame:
    """One narrow row per document: (_id, _ord, _dig, _bkeys).

    Text is read once, map-side; only these small rows are shuffled later."""
    keys = dedup_keys(F.coalesce(F.col(text_col), F.lit("")), p.num_perm, p.bands, p.rows)
    return docs.select(
        F.col(id_col).alias("_id"), F.col(order_col).alias("_ord"),
        keys["digest"].alias("_dig"), keys["bkeys"].alias("_bkeys"))


def first_copies(sigs: DataFrame) -> DataFrame:
    """Adds _first: the document is the earliest of its exact token set.

    The earliest order per digest comes from a partial (map-side) aggregate;
    it is joined back on the unique pair (digest, order), so a digest shared
    by a third of all rows does not make one hot join key."""
    firsts = sigs.groupBy("_dig").agg(F.min("_ord").alias("_ord")).withColumn(
        "_first", F.lit(True))
    return sigs.join(firsts, ["_dig", "_ord"], "left").withColumn(
        "_first", F.coalesce(F.col("_first"), F.lit(False)))


def explode_bands(sigs: DataFrame) -> DataFrame:
    """(_id, _ord, _band, _bkey) membership rows."""
    return sigs.select("_id", "_ord",
                       F.posexplode("_bkeys").alias("_band", "_bkey"))


def bucket_members(docs: DataFrame, id_col: str, order_col: str, text_col: str,
                   p: HarvestParams = HarvestParams()) -> DataFrame:
    """J3 input: (_id, _ord, _band, _bkey) for every document and band.

    The band keys are written before they are exploded: below an explode Spark filters by
    the size of its input, and would compute the signatures once more for that filter."""
    sigs = doc_signatures(docs, id_col, order_col, text_col, p).select("_id", "_ord", "_bkeys")
    return explode_bands(materialise(sigs, "band-keys"))


BUCKET = ["_band", "_bkey"]


def shared_buckets(members: DataFrame) -> DataFrame:
    """Member rows of buckets with two or more members."""
    sizes = materialise(members.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("_n"))
                        .where("_n > 1").select(*BUCKET), "shared-buckets")
    return members.join(sizes, BUCKET, "left_semi")


def first_two(members: DataFrame) -> DataFrame:
    """(_band, _bkey, _min1, _min2): the two smallest orders of each bucket.  They come from
    one ranking, which Spark limits to two rows per bucket in each task before it shuffles them."""
    rank = Window.partitionBy(*BUCKET).orderBy("_ord")
    return (members.select(*BUCKET, "_ord").withColumn("_r", F.row_number().over(rank))
            .where("_r <= 2").groupBy(*BUCKET)
            .agg(F.min("_ord").alias("_min1"), F.max(F.when(F.col("_r") == 2, F.col("_ord"))).alias("_min2")))


def neighbours(edges: DataFrame, low: DataFrame) -> DataFrame:
    """(_id, _ord, _won, _parent) per document: whether it has no undecided earlier neighbour,
    and the order of that neighbour if it has exactly one.  Of a bucket that is the first
    member for the second one; a third member has two."""
    later = F.col("_ord") != F.col("_min1")
    seen = edges.join(low, BUCKET).groupBy("_id", "_ord").agg(
        F.max(later).alias("_later"), F.max(F.col("_ord") > F.col("_min2")).alias("_third"),
        F.min(F.when(later, F.col("_min1"))).alias("_p1"), F.max(F.when(later, F.col("_min1"))).alias("_p2"))
    single = F.col("_later") & ~F.coalesce("_third", F.lit(False)) & (F.col("_p1") == F.col("_p2"))
    return seen.select("_id", "_ord", (~F.col("_later")).alias("_won"), F.when(single, F.col("_p1")).alias("_parent"))


def chain_kept(known: DataFrame) -> tuple[DataFrame | None, int]:
    """(_id, _ord) kept through links to one earlier neighbour, and the joins that it took.
    ``known`` (a written table) is that of ``neighbours``."""
    links = known.where("_parent IS NOT NULL").select("_id", "_ord", F.col("_parent").alias("_to"),
                                                      F.lit(True).alias("_odd"))
    steps, moved = 0, True
    while moved:
        far = links.select(F.col("_ord").alias("_to"), F.col("_to").alias("_far"), F.col("_odd").alias("_far_odd"))
        doubled = links.join(far, "_to", "left").select(
            "_id", "_ord", F.coalesce("_far", "_to").alias("_to"),
            (F.col("_odd") != F.coalesce("_far_odd", F.lit(False))).alias("_odd"),
            F.col("_far").isNotNull().alias("_moved"))
        links = materialise(doubled, "greedy-links")
        moved = not links.where("_moved").isEmpty()
        steps += moved
        links = links.drop("_moved")
    if not steps:           # no link leads on to another: dropped with their kept neighbour's buckets
        return None, 0
    roots = known.where("_won").select(F.col("_ord").alias("_to"))
    return links.where("NOT _odd").join(roots, "_to", "left_semi").select("_id", "_ord"), steps


def greedy_rounds(members: DataFrame) -> DataFrame:
    """D1 on bucket membership rows (_id, _ord, _band, _bkey): returns
    (_id, _keep) for every id in ``members``."""
    edges = materialise(shared_buckets(members), "greedy-edges")
    alone = members.select("_id").distinct().join(edges.select("_id").distinct(), "_id", "left_anti")
    kept = [alone]
    rounds = 0
    while not edges.isEmpty():
        low = materialise(first_two(edges), "greedy-first")
        known = materialise(neighbours(edges, low), "greedy-known")
        won = known.where("_won").select("_id")
        through, steps = chain_kept(known)
        if through is not None:
            won = materialise(won.unionByName(through.select("_id")), "greedy-kept")
        rounds += 1 + steps
        taken = materialise(edges.join(won, "_id", "left_semi").select(*BUCKET).distinct(), "greedy-taken")
        decided = edges.join(taken, BUCKET, "left_semi").select("_id").distinct()
        edges = materialise(edges.join(decided, "_id", "left_anti"), "greedy-edges")
        kept.append(won)
    log.info("greedy dedup finished after %d rounds", rounds)
    kept_ids = reduce(DataFrame.unionByName, kept).withColumn("_keep", F.lit(True))
    return members.select("_id").distinct().join(kept_ids, "_id", "left").select(
        "_id", F.coalesce("_keep", F.lit(False)).alias("_keep"))


def greedy_dedup_sigs(sigs: DataFrame, prior_buckets: DataFrame | None = None,
                      with_buckets: bool = False):
    """D1 on narrow signature rows (_id, _ord, _dig, _bkeys).

    Returns (_id, keep) for every row, and with ``with_buckets`` also the
    (band, bkey, _id) buckets of the documents kept here."""
    sigs = cut_lineage(first_copies(sigs))
    members = explode_bands(sigs.where("_first"))
    if prior_buckets is not None:
        hit = members.join(
            prior_buckets.select(F.col("band").alias("_band"), F.col("bkey").alias("_bkey")),
            ["_band", "_bkey"], "left_semi").select("_id").distinct()
        members = members.join(hit, "_id", "left_anti")
    verdict = greedy_rounds(members)
    out = sigs.select("_id").join(verdict, "_id", "left").select(
        "_id", F.coalesce(F.col("_keep"), F.lit(False)).alias("keep"))
    if not with_buckets:
        return out
    kept = explode_bands(sigs.join(verdict.where("_keep").select("_id"), "_id", "left_semi"))
    buckets = kept.select(F.col("_band").alias("band"), F.col("_bkey").alias("bkey"), "_id")
    return out, buckets


def greedy_dedup(docs: DataFrame, id_col: str, order_col: str, text_col: str,
                 p: HarvestParams = HarvestParams(),
                 prior_buckets: DataFrame | None = None,
                 with_buckets: bool = False):
    """D1 over a text table: DataFrame (id_col, keep) covering every input row.

    ``prior_buckets`` (band, bkey) are buckets of documents kept earlier
    (previous crawl levels / micro-batches): any hit is a duplicate.
    With ``with_buckets`` also returns the (band, bkey, id_col) buckets of
    the documents kept here (to extend the prior buckets of later calls).
    """
    # materialise the narrow signature rows once: they feed both the
    # exact-copy aggregate and the join back, which would otherwise each
    # re-run tokenisation and the MinHash UDF
    sigs = cut_lineage(doc_signatures(docs, id_col, order_col, text_col, p))
    res = greedy_dedup_sigs(sigs, prior_buckets, with_buckets)
    if not with_buckets:
        return res.withColumnRenamed("_id", id_col)
    out, buckets = res
    return out.withColumnRenamed("_id", id_col), buckets.withColumnRenamed("_id", id_col)


def greedy_dedup_docs(docs: DataFrame, id_col: str, text_col: str,
                      p: HarvestParams = HarvestParams()) -> DataFrame:
    """D1 with order = id (document tables)."""
    return greedy_dedup(docs, id_col, id_col, text_col, p)


def lsh_candidates(docs: DataFrame, id_col: str, text_col: str,
                   p: HarvestParams = HarvestParams()) -> DataFrame:
    """J3 without emitting pairs: per document, the earliest other document it
    shares a bucket with (``first_candidate``, NULL if none) and the number
    of its bands that collide with an earlier document (``n_bands_hit``)."""
    return candidates_from_members(bucket_members(docs, id_col, id_col, text_col, p), id_col)


def candidates_from_members(members: DataFrame, id_col: str) -> DataFrame:
    """J3 on membership rows (_id, _ord, _band, _bkey); see ``lsh_candidates``."""
    low = first_two(members)
    j = members.join(materialise(low, "bucket-first-two"), BUCKET)
    other = F.when(F.col("_ord") == F.col("_min1"), F.col("_min2")).otherwise(F.col("_min1"))
    return j.groupBy(F.col("_id").alias(id_col)).agg(
        F.min(other).alias("first_candidate"),
        F.sum((F.col("_min1") < F.col("_ord")).cast("bigint")).alias("n_bands_hit"))
