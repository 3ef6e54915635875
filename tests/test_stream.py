"""K micro-batches give the same samples as one batch in the same order;
a restart with the same checkpoint adds nothing (exactly once)."""

import os

from pyspark.sql import functions as F

from docforge.session import scratch_path
from docforge.streaming.incremental import (PAGE_SCHEMA, decision_report, process_batch, read_samples_sink, read_sink,
                                            start_incremental_harvest)
from tests.conftest import SF_SMALL
from tests.test_crawl import long_text, page


def _run(spark, src, out, per_trigger):
    q = start_incremental_harvest(spark, src, out, max_files_per_trigger=per_trigger)
    q.awaitTermination()


def test_batches_equal_single_batch(spark):
    pages = spark.read.parquet(os.path.join(SF_SMALL, "pages.parquet"))
    src = scratch_path(spark, "pages-src")
    mid = pages.approxQuantile("page_id", [0.5], 0.0)[0]
    pages.where(F.col("page_id") <= mid).coalesce(1).write.parquet(os.path.join(src, "a"))
    pages.where(F.col("page_id") > mid).coalesce(1).write.parquet(os.path.join(src, "b"))
    one, two = scratch_path(spark, "one"), scratch_path(spark, "two")
    # one batch over everything vs. one file per trigger (files are read in name order)
    q = start_incremental_harvest(spark, src + "/*", one, max_files_per_trigger=100)
    q.awaitTermination()
    q = start_incremental_harvest(spark, src + "/*", two, max_files_per_trigger=1)
    q.awaitTermination()
    a = sorted(tuple(r) for r in read_samples_sink(spark, one).drop("batch_id").collect())
    b = sorted(tuple(r) for r in read_samples_sink(spark, two).drop("batch_id").collect())
    assert a == b and len(a) > 0
    # restart on the same checkpoint: no new batch, same output
    q = start_incremental_harvest(spark, src + "/*", two, max_files_per_trigger=1)
    q.awaitTermination()
    c = sorted(tuple(r) for r in read_samples_sink(spark, two).drop("batch_id").collect())
    assert c == b


def harvest(spark, batches, domains=None):
    """Run the batches one after the other through the stream's own function."""
    out = scratch_path(spark, "stream-test")
    for k, rows in enumerate(batches):
        process_batch(spark.createDataFrame(rows, PAGE_SCHEMA), k, out, domains=domains)
    return out


def outputs(spark, out):
    return sorted((r.url, r.output[:6]) for r in read_samples_sink(spark, out).collect())


def html(word, *links):
    return page("", long_text(word), list(links))[1]


def test_empty_first_batches(spark):
    rows = [(1, "https://h/a", html("aaaaaa"))]
    assert read_samples_sink(spark, scratch_path(spark, "none")).count() == 0
    out = harvest(spark, [[], [(7, "https://h/s", "<p>short</p>")], rows])
    assert outputs(spark, out) == outputs(spark, harvest(spark, [rows])) != []


def test_first_page_of_a_url_wins_within_and_across_batches(spark):
    one, two, three = html("oneone"), html("twotwo"), html("threee")
    out = harvest(spark, [[(9, "https://h/a", one), (1, "https://h/a", two)],
                          [(0, "https://h/a", three), (3, "https://h/b", three)]])
    got = {u: o for u, o in outputs(spark, out)}
    assert got == {"https://h/a": "twotwo", "https://h/b": "threee"}


def test_allow_list_and_links(spark):
    domains = spark.createDataFrame([("h",)], "domain string")
    out = harvest(spark, [
        [(1, "https://evil/a", html("evilev")),
         (2, "https://h/a", html("goodgo", "mailto:a@b", "https://evil/x", "/b", "/a", "//h/c"))],
        [(3, "https://h/d", html("dddddd", "/a", "/e"))]], domains)
    assert {u for u, _ in outputs(spark, out)} == {"https://h/a", "https://h/d"}
    links = [(r.batch_id, r.link) for r in read_sink(spark, out, "discovered_links").collect()]
    assert sorted(links) == [(0, "https://h/b"), (0, "https://h/c"), (1, "https://h/e")]


def test_replayed_batch_changes_nothing_and_history_dedups(spark):
    a, b = (1, "https://h/a", html("samesa")), (2, "https://h/b", html("samesa"))
    out = harvest(spark, [[a], [b]])
    before = outputs(spark, out)
    process_batch(spark.createDataFrame([b], PAGE_SCHEMA), 1, out)
    assert outputs(spark, out) == before and {u for u, _ in before} == {"https://h/a"}


def test_every_page_has_a_decision(spark):
    domains = spark.createDataFrame([("h",)], "domain string")
    a, b = html("aaaaaa"), html("bbbbbb")
    out = harvest(spark, [
        [(1, "https://h/a", a), (2, "https://h/a", b), (3, "https://evil/", a), (4, None, a), (5, "https://h/s", "<p>s</p>"),
         (6, "https://h/f", None), (None, "https://h/n", b)],
        [(7, "https://h/a", b), (8, "https://h/c", a), (8, "https://h/c", a), (None, None, None)]], domains)
    got = {(r.batch_id, r.page_id, r.url): (r.gate_reason, r.n_samples > 0) for r in read_sink(spark, out, "decisions").collect()}
    assert got == {
        (0, 1, "https://h/a"): ("kept", True), (0, 2, "https://h/a"): ("repeated", False),
        (0, 3, "https://evil/"): ("not_allowed", False), (0, 4, None): ("no_url", False),
        (0, 5, "https://h/s"): ("short", False), (0, 6, "https://h/f"): ("fetch_failed", False),
        (0, None, "https://h/n"): ("kept", True), (1, 7, "https://h/a"): ("seen", False),
        (1, 8, "https://h/c"): ("duplicate", False), (1, None, None): ("no_url", False)}
    report = {(r.batch_id, r.gate_reason): r.n for r in decision_report(spark, out).collect()}
    assert report[(0, "kept")] == 2 and report[(1, "seen")] == 1 and sum(report.values()) == len(got)
    total = read_sink(spark, out, "decisions").agg(F.sum("n_samples")).first()[0]
    assert total == read_samples_sink(spark, out).count()


def test_json_lines_come_exactly_once(spark, monkeypatch):
    from docforge.sources import samples_io
    out, jsonl = scratch_path(spark, "stream-test"), scratch_path(spark, "lines")
    batch = spark.createDataFrame([(1, "https://h/a", html("aaaaaa"))], PAGE_SCHEMA)
    assert samples_io.read_batches(spark, jsonl).count() == 0

    def killed(*a):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:     # after its files, before its manifest
        m.setattr(samples_io, "_write_text", killed)
        try:
            process_batch(batch, 0, out, jsonl=jsonl)
        except RuntimeError:
            pass
    assert samples_io.read_batches(spark, jsonl).count() == 0
    process_batch(batch, 0, out, jsonl=jsonl)
    process_batch(batch, 0, out, jsonl=jsonl)
    want = sorted(map(str, read_samples_sink(spark, out).select("instruction", "input", "output").collect()))
    lines = samples_io.read_batches(spark, jsonl)
    assert want and sorted(map(str, lines.select("instruction", "input", "output").collect())) == want
    assert not [r for r in lines.collect() if r._corrupt]
