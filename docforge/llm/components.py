"""Connected components of an edge table by alternating star contraction.

Large-star links every larger neighbour of a node to the node's smallest
neighbour, small-star does so for the smaller ones; the edges end as stars
whose centres are the smallest nodes.  Every round is written to the shared
scratch folder, so lineage stays short and a join on a hub node has two
written sides, which adaptive execution can split.  Nothing is collected but
one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest
    node that it is connected with.  Self loops are ignored."""
    e = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select("v", "u"))
        low = written(both.groupBy("u").agg(F.min("v").alias("m"))
                      .select("u", F.least("u", "m").alias("m")), "large-star-min")
        e = written(both.join(low, "u").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = written(e.groupBy("u").agg(F.min("v").alias("m")), "small-star-min")
        linked = e.join(low, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(linked.union(low).distinct(), "small-star")
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select("v", "v").distinct())


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def contract(stars: DataFrame) -> DataFrame:
    """(node, root) from local stars (node, star), star being the smallest node
    of some task's part of a component.  A node in several stars links them;
    only the stars' centres go through the rounds, so a component with a third
    of all nodes costs as many edges as it had parts."""
    stars = written(stars, "stars")
    first = stars.groupBy("node").agg(F.min("star").alias("first"), F.max("star").alias("last"))
    first = written(first, "first-star")
    several = first.where("first <> last").select("node", "first")
    links = stars.join(several, "node").select(
        F.col("star").alias("a"), F.col("first").alias("b")).distinct()
    roots = written(components(links), "star-roots")
    return (first.select("node", F.col("first").alias("star"))
            .join(roots.select(F.col("node").alias("star"), "root"), "star", "left")
            .select("node", F.coalesce("root", "star").alias("root")))
