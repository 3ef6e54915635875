"""J4's page store: pruned and exchange-free fetches, pages on demand, stale stores."""
import pytest
from pyspark.sql import functions as F

from docforge.params import HarvestParams
from docforge.plans.crawl import crawl, facts_of, seeds_frame
from docforge.session import materialise, scratch_path
from docforge.sources import page_store
from docforge.sources.page_store import PageStore, StaleStore
from tests.test_crawl import long_text, page

PLAIN = HarvestParams(extractor=lambda html: F.concat(html, F.repeat(F.lit(" word"), 200)), grader=lambda t: F.lit(20.0))


def pages_of(spark, n, extra=()):
    rows = [(k, f"https://h/{k}", f"body {k}") for k in range(n)] + list(extra)
    return materialise(spark.createDataFrame(rows, "page_id long, url string, html string"), "pages")


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark):
    old = page_store.BUCKET_URLS
    page_store.BUCKET_URLS = 10
    s = PageStore(pages_of(spark, 400), scratch_path(spark, "store"), PLAIN, facts_of)
    page_store.BUCKET_URLS = old
    s.reduce_all()
    yield s
    s.close()


def test_a_small_frontier_reads_its_buckets_alone(spark, store):
    assert store.buckets == 40 and store.runs == [400]
    ask = materialise(spark.createDataFrame([("https://h/7",), ("https://h/11",), ("https://none/",)], "url string"), "f")
    got = store.fetch(ask, ["page_id", "gate_reason"])
    assert {(r.url, r.page_id, r.gate_reason) for r in got.collect()} == {
        ("https://h/7", 7, "pass"), ("https://h/11", 11, "pass")}
    files = got.inputFiles()
    assert len([f for f in files if "run=0" in f]) <= 3
    plan = plan_of(got)
    assert "SortMergeJoin" not in plan and "ReadSchema: struct<url:string,page_id:bigint,gate_reason:string>" in plan


def test_a_large_frontier_joins_without_an_exchange_of_the_store(spark, store):
    ask = materialise(spark.range(300).select(F.concat(F.lit("https://h/"), F.col("id")).alias("url")), "f")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = store.fetch(ask, ["gate_reason"])
        assert got.count() == 300
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_pages_are_reduced_on_demand(spark):
    """A budget of a few samples extracts at most twice the processed pages."""
    pages = pages_of(spark, 300)
    seeds = pages.select(F.col("page_id").alias("pos"), "url")
    domains = spark.createDataFrame([("h",)], "domain string")
    p = HarvestParams(max_samples=40, extractor=lambda html: F.concat(
        F.md5(html), F.lit("\n\n"), F.repeat(F.concat(F.lit(" "), F.md5(html)), 90), F.lit("\n\n"), F.md5(html)),
        grader=PLAIN.grader)
    res = crawl(seeds, domains, pages, p)
    done = res.log.count()
    assert res.stopped_by_budget and 40 <= res.collected < 45
    assert done == 40 and res.pages_extracted <= max(2 * done, 64)
    whole = crawl(seeds, domains, pages, HarvestParams(max_samples=10**6, extractor=p.extractor, grader=p.grader))
    assert whole.pages_extracted == 300
    first = sorted(map(str, whole.log.where("page_id < 40").collect()))
    assert sorted(map(str, res.log.collect())) == first


def test_other_pages_or_parameters_are_refused(spark):
    state = scratch_path(spark, "state")
    domains = spark.createDataFrame([("h",)], "domain string")
    pages = pages_of(spark, 3)
    seeds = seeds_frame(spark, ["https://h/0"])
    first = crawl(seeds, domains, pages, PLAIN, state_dir=state)
    import dataclasses
    crawl(seeds, domains, pages, dataclasses.replace(PLAIN, max_samples=7), state_dir=state)   # the budget may differ
    with pytest.raises(StaleStore):
        crawl(seeds, domains, pages, dataclasses.replace(PLAIN, min_length=7), state_dir=state)
    with pytest.raises(StaleStore):
        crawl(seeds, domains, pages_of(spark, 4), PLAIN, state_dir=state)
    assert first.log.count() == 1


def test_repeated_urls_null_ids_and_bytes(spark):
    html = page("", long_text("aaa"), [])[1].encode()
    rows = [(None, "https://h/a", html), (4, "https://h/a", b"\xff\xfe" + html.decode().encode("utf-16-le")),
            (4, "https://h/a", b"x"), (None, "https://h/b", html), (5, None, html), (6, "https://h/c", b"\xff\xff\xff"),
            (7, "https://h/d", b""), (8, "https://h/e", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary")
    seeds = seeds_frame(spark, [f"https://h/{c}" for c in "abcde"])
    res = crawl(seeds, spark.createDataFrame([("h",)], "domain string"), pages)
    got = {r.url[-1]: (r.page_id, r.gate_reason) for r in res.log.collect()}
    assert got["a"][0] == 4 and got["b"][0] is None and got["b"][1] in ("kept", "duplicate")
    assert got["c"] == (6, "undecodable") and got["d"] == (7, "fetch_failed") and got["e"] == (8, "fetch_failed")
