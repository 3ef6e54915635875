"""A key with a third of all rows: the joins are split by AQE (plan tests)."""
import pytest
from pyspark.sql import functions as F

from docforge.operators import dedup, links
from docforge.session import materialise

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def hot_members(spark, n=30_000):
    ids = spark.range(n, numPartitions=8)
    return ids.select(F.col("id").alias("_id"), F.col("id").alias("_ord"), F.lit(0).alias("_band"),
                      F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
                          F.concat(F.lit("b"), (F.col("id") / 5).cast("long"))).alias("_bkey"))


def test_bucket_joins_are_split(skewed):
    """The library's own frames: shared buckets, and the join that finds neighbours."""
    members = materialise(hot_members(skewed), "m")
    shared = dedup.shared_buckets(members)
    rows, plan = executed(shared)
    assert "skew=true" in plan
    edges = materialise(shared, "e")
    _, plan = executed(dedup.neighbours(edges, materialise(dedup.first_two(edges), "low")))
    assert "skew=true" in plan


def test_hot_bucket_results(spark):
    members = hot_members(spark, 3000)
    keep = {r._id: r._keep for r in dedup.greedy_rounds(members).collect()}
    assert len(keep) == 3000
    seen, want = set(), {}
    for r in sorted(members.collect(), key=lambda r: r._ord):
        want[r._id] = r._bkey not in seen
        seen.add(r._bkey)
    assert keep == want
    got = {r.k: (r.first_candidate, r.n_bands_hit) for r in
           dedup.candidates_from_members(materialise(members, "m"), "k").collect()}
    by = {}
    for r in members.collect():
        by.setdefault(r._bkey, []).append(r._id)
    for r in members.collect():
        ids = sorted(by[r._bkey])
        others = [x for x in ids if x != r._id]
        assert got[r._id] == (others[0] if others else None, int(ids[0] < r._id))


def test_candidate_ranking_is_limited_before_the_shuffle(spark):
    low = dedup.first_two(hot_members(spark, 300))
    assert "WindowGroupLimit" in low._jdf.queryExecution().executedPlan().toString()


def test_hot_link_is_split(skewed):
    n = 30_000
    rows = skewed.range(n, numPartitions=8).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("https://h/hot")).otherwise(
            F.concat(F.lit("https://h/"), F.col("id"))).alias("link"))
    seen = materialise(skewed.range(0, n, 7).select(F.concat(F.lit("https://h/"), F.col("id")).alias("url")), "v")
    got, plan = executed(links.not_visited(materialise(rows, "l"), "link", seen))
    assert "skew=true" in plan
    visited = {f"https://h/{i}" for i in range(0, n, 7)}
    assert len(got) == sum(1 for i in range(n) if i % 3 == 0 or f"https://h/{i}" not in visited)
