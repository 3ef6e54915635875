"""G1 crawl closure on the hand-made graph (FIXTURES section 5)."""

import pytest
from pyspark.sql import functions as F

from docforge.params import HarvestParams
from docforge.plans.crawl import crawl, default_crawl, seeds_frame
from docforge.session import scratch_path

TECH = ("The implementation of multi-factor authentication utilizing cryptographic "
        "protocols enhances security posture significantly. ")


def long_text(word: str, n_par: int = 3) -> str:
    # distinct, long, technical paragraphs (each ~1000 chars)
    par = (f"{word} " + TECH * 8).strip()
    return "\n\n".join(f"{par} {word}{i}" for i in range(n_par))


def page(url, body, links):
    a = "".join(f'<a href="{l}">x</a>' for l in links)
    paras = "".join(f"<p>{x}</p>" for x in body.split("\n\n"))
    return (url, f"<html><body><nav>{a}</nav><article>{paras}</article></body></html>")


def graph(spark):
    p2_text = long_text("alpha")
    rows = [
        page("https://h/p1", long_text("one"), ["/p2", "/p3", "//z/"]),
        page("https://h/p2", p2_text, ["/p4"]),
        page("https://h/p3", p2_text, ["/p5"]),
        page("https://h/p4", long_text("four"), ["/p1", "/p6"]),
        page("https://h/p6", "tiny page", ["/p7"]),
        page("https://h/p7", long_text("seven"), []),
        page("https://h/p5", long_text("five"), []),
        page("https://z/", long_text("zed"), []),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)],
                                  "page_id long, url string, html string")
    domains = spark.createDataFrame([("h",)], "domain string")
    return pages, domains


@pytest.fixture(scope="module")
def whole(spark):
    """The graph's crawl in one run."""
    pages, domains = graph(spark)
    return crawl(seeds_frame(spark, ["https://h/p1"]), domains, pages, HarvestParams())


def test_crawl_graph_order_and_reasons(whole):
    res = whole
    got = {r.url: (r.depth, r.gate_reason) for r in res.log.collect()}
    assert got == {
        "https://h/p1": (0, "kept"),
        "https://h/p2": (1, "kept"),
        "https://h/p3": (1, "duplicate"),
        "https://h/p4": (2, "kept"),
        "https://h/p6": (3, "short"),
    }
    order = [r.url for r in res.log.orderBy("depth", "crawl_key").collect()]
    assert order == ["https://h/p1", "https://h/p2", "https://h/p3", "https://h/p4",
                     "https://h/p6"]
    n = res.samples.count()
    assert n == res.collected > 0
    assert res.samples.where(~F.col("input").startswith("Source: https://h/")).count() == 0


def test_crawl_budget_stops_between_pages(spark):
    pages, domains = graph(spark)
    p = HarvestParams(max_samples=2, chunk_max=1100, chunk_min=200)
    res = crawl(seeds_frame(spark, ["https://h/p1"]), domains, pages, p)
    per_page = {r.url: r.n_samples for r in res.log.collect()}
    # p1 gives 2 samples; budget reached -> nothing after p1 is visited
    assert list(per_page) == ["https://h/p1"]
    assert res.stopped_by_budget
    assert res.collected == per_page["https://h/p1"] >= 2


def rows(df):
    return sorted(map(str, df.collect()))


def test_chain_is_crawled_to_its_end(spark):
    """No bound on depth: the run ends when the frontier is empty."""
    n = 4
    data = [page(f"https://h/{i}", long_text(f"w{i}x"), [f"/{i + 1}"]) for i in range(n)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(data)],
                                  "page_id long, url string, html string")
    res = crawl(seeds_frame(spark, ["https://h/0"]), spark.createDataFrame([("h",)], "domain string"),
                pages, HarvestParams(threshold=0.999))
    got = {r.url: r.depth for r in res.log.collect()}
    assert got == {f"https://h/{i}": i for i in range(n + 1)}
    assert not res.stopped_by_budget and not hasattr(HarvestParams(), "max_depth")


def test_resume_after_every_step_equals_one_run(spark, whole):
    pages, domains = graph(spark)
    seeds = seeds_frame(spark, ["https://h/p1"])
    state = scratch_path(spark, "resume")
    steps = 0
    while True:      # one step per run, as if the run were killed after each
        res = crawl(seeds, domains, pages, state_dir=state, max_steps=1)
        if res.steps == steps:
            break
        steps = res.steps
    assert steps == whole.steps > 2
    assert rows(res.log) == rows(whole.log) and rows(res.samples) == rows(whole.samples)
    assert res.collected == whole.collected == res.samples.count()


def test_step_without_marker_is_made_again(spark, whole):
    from docforge.sources.state import CrawlState, MARKER
    pages, domains = graph(spark)
    seeds = seeds_frame(spark, ["https://h/p1"])
    state = scratch_path(spark, "uncommitted")
    crawl(seeds, domains, pages, state_dir=state, max_steps=2)
    last = CrawlState(spark, state).folder(1, MARKER)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, False)
    assert CrawlState(spark, state).steps == 1
    res = crawl(seeds, domains, pages, state_dir=state)
    assert rows(res.log) == rows(whole.log) and rows(res.samples) == rows(whole.samples)


def test_larger_budget_goes_on_where_a_smaller_one_stopped(spark, whole):
    pages, domains = graph(spark)
    seeds = seeds_frame(spark, ["https://h/p1"])
    state = scratch_path(spark, "budget")
    small = crawl(seeds, domains, pages, HarvestParams(max_samples=1), state_dir=state)
    assert small.stopped_by_budget and small.log.count() < whole.log.count()
    res = crawl(seeds, domains, pages, state_dir=state)
    order = [r.url for r in res.log.orderBy("depth", "crawl_key").collect()]
    assert order == [r.url for r in whole.log.orderBy("depth", "crawl_key").collect()]
    assert rows(res.samples) == rows(whole.samples)


def test_repeated_urls_take_the_first_page(spark):
    a, b = page("https://h/p", long_text("first"), []), page("https://h/p", long_text("second"), [])
    pages = spark.createDataFrame([(5, *b), (2, *a), (2, *a), (9, *b)], "page_id long, url string, html string")
    res = crawl(seeds_frame(spark, ["https://h/p", "https://h/p", "mailto:x@h", "https://z/"]),
                spark.createDataFrame([("h",)], "domain string"), pages)
    assert [(r.url, r.page_id) for r in res.log.collect()] == [("https://h/p", 2)]
    assert all(r.output.startswith("first") for r in res.samples.collect()) and res.collected > 0


def test_default_crawl(spark):
    from docforge.params import SEED_URLS
    pages = spark.createDataFrame([(0, *page(SEED_URLS[3], long_text("pods"), ["/docs/x", "https://evil/"]))],
                                  "page_id long, url string, html string")
    got = {r.url: r.gate_reason for r in default_crawl(pages).log.collect()}
    assert got[SEED_URLS[3]] == "kept" and got["https://kubernetes.io/docs/x"] == "fetch_failed"
    assert len(got) == len(SEED_URLS) + 1


def test_stages_can_be_replaced(spark):
    pages, domains = graph(spark)
    p = HarvestParams(extractor=lambda html: F.concat(F.lit("title "), F.repeat(F.lit("word "), 200), html),
                      grader=lambda text: F.lit(20.0))
    got = crawl(seeds_frame(spark, ["https://h/p6"]), domains, pages, p).log
    assert got.where("url = 'https://h/p6'").first().gate_reason == "kept"
