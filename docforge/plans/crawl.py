"""G1 crawl_closure: the whole harvest run over a table of fetched pages.

Pages are looked up in a page store below the state directory (J4, sources/page_store.py),
bucketed by URL.  Where the budget can't end the run before the pages do, all pages are
reduced in one pass over the HTML.  With a smaller budget, pages are reduced on demand, until
100,000 URLs are processed: some twelve passes at most, then one for all that is left.

Steps go in breadth-first order.  FIFO order is the key ``(depth, crawl_key)``,
``crawl_key`` = parent's key ++ [link position] (seeds: [seed position]); the first
enqueue of a URL wins.  A step takes the frontier's rows of the smallest depth; with
a small budget (O2) only a prefix of them in crawl order, as many as were processed
so far, so that at most twice the processed pages are ever extracted:

1. not visited (J1/F1), host allowed (J2/F2)
2. fetch (J4): narrow facts of the step's URLs
3. greedy dedup (D1) against the buckets of earlier steps, then in crawl order
4. budget (O2): a page is processed iff the samples collected before it are below
   ``max_samples``; the rest stays in the frontier, and the run stops
5. links (L1) of processed *kept* pages only, allowed and unseen, join the frontier;
   links and text are fetched for these pages alone
6. samples of kept pages are written, then log, buckets and frontier, then the
   step is committed (S5)

Visited URLs and buckets of kept pages are key histories (sources/history.py), of which a
step reads what its own keys may hit.

The run ends with an empty frontier or a spent budget; there is no bound on
depth.  Log and samples of the result are the union of all committed steps, so
a run that was broken off and resumed (S6) returns what an unbroken one does.
Resuming with other pages or parameters (the budget apart) is an error.
"""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import decode_payload, main_text
from ..functions.minhash import dedup_keys
from ..functions.samples import instruction, source_tag
from ..functions.url import hrefs, netloc, with_url_join
from ..operators.chunk import chunk, chunk_count
from ..operators.dedup import explode_bands, greedy_dedup_sigs
from ..operators.gates import gate_reason
from ..operators.links import domain_allowed, not_visited, prepare_domains, resolved
from ..operators.ordering import running_sum
from ..params import HarvestParams
from ..session import cut_lineage, materialise, scratch_path, spread
from ..sources.page_store import FEW, PageStore
from ..sources.prompts import default_domains, default_seeds
from ..sources.state import CrawlState

log = logging.getLogger(__name__)

#: pages of the first prefix of a run with a small budget; the largest that is cut exactly
FIRST, EXACT = 32, 10_000
UNSPENT = 1 << 62


@dataclass
class CrawlResult:
    log: DataFrame          # one row per processed (visited) URL
    samples: DataFrame      # (url, chunk_no, instruction, input, output)
    collected: int
    steps: int
    stopped_by_budget: bool
    pages_extracted: int = 0


def seeds_frame(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Start URLs in queue order (pos, url)."""
    return spark.createDataFrame(list(enumerate(urls)), "pos long, url string")


def page_rows(pages: DataFrame, p: HarvestParams = HarvestParams()) -> DataFrame:
    """X4 + gates (+ links, signatures, chunk counts of passing pages), map-side.  Payloads in
    bytes are decoded first (F10); those that can't be are ``undecodable``."""
    extract = p.extractor or main_text
    nofetch = F.col("html").isNull() | (F.length("html") == 0)
    undecodable = F.lit(False)
    if isinstance(pages.schema["html"].dataType, T.BinaryType):
        pages = pages.select("page_id", "url", nofetch.alias("_nofetch"), decode_payload(F.col("html"))["html"].alias("html"))
        nofetch, undecodable = F.col("_nofetch"), F.col("html").isNull()
    rows = pages.select(
        "page_id", "url", extract(F.col("html")).alias("text"), hrefs(F.col("html")).alias("hrefs"),
        F.when(nofetch, F.lit("fetch_failed")).when(undecodable, F.lit("undecodable")).alias("_failed"))
    rows = rows.withColumn("gate_reason", F.coalesce("_failed", gate_reason(F.col("text"), p)))
    ok = F.col("gate_reason") == "pass"
    text = F.when(ok, F.col("text"))
    keys = dedup_keys(text, p.num_perm, p.bands, p.rows)
    return rows.select(
        "page_id", "url", text.alias("text"), "hrefs", "gate_reason",
        F.when(ok, chunk_count(text, p)).otherwise(F.lit(0).cast("bigint")).alias("_nchunks"),
        keys["digest"].alias("_dig"), keys["bkeys"].alias("_bkeys"))


def facts_of(pages: DataFrame, p: HarvestParams) -> DataFrame:
    return page_rows(spread(pages), p)


def _prefix(now: DataFrame, n: int, take: int) -> DataFrame:
    """About the ``take`` first rows of ``now`` (n rows, a written table) in crawl order; any prefix is
    right.  A large one is cut at a sampled key."""
    if take >= n:
        return now
    if take <= EXACT:
        last = now.select("crawl_key").orderBy("crawl_key").limit(take).agg(F.max("crawl_key")).first()[0]
    else:
        sample = now.select("crawl_key").orderBy(F.xxhash64("url")).limit(EXACT).collect()
        keys = sorted(r.crawl_key for r in sample)
        last = keys[min(len(keys) - 1, take * len(keys) // n)]
    return now.where(F.col("crawl_key") <= F.array(*[F.lit(x).cast("bigint") for x in last]))


def crawl(seeds: DataFrame, domains: DataFrame, pages: DataFrame,
          p: HarvestParams = HarvestParams(), state_dir: str | None = None,
          max_steps: int | None = None) -> CrawlResult:
    """Run G1 from the state found in ``state_dir`` (S6; a fresh scratch folder by
    default) to its end, or for ``max_steps`` more steps."""
    spark = seeds.sparkSession
    state_dir = state_dir or scratch_path(spark, "crawl")
    state = CrawlState(spark, state_dir)
    store = PageStore(pages, os.path.join(state_dir, "pages"), p, facts_of)
    allowed = prepare_domains(domains)
    frontier = state.frontier()
    if frontier is None:
        frontier = seeds.select("url", F.lit(0).alias("depth"), F.array(
            F.col("pos").cast("bigint")).alias("crawl_key"))
    made = 0
    depth = state.depth if state.steps else 0
    while depth is not None and state.collected < p.max_samples and (max_steps is None or made < max_steps):
        # a small budget may end the run long before the pages are used up
        take = max(FIRST, state.processed) if p.max_samples < store.n_urls else FEW + 1
        if take > FEW:
            store.reduce_all()
            take = None
        _step(state, frontier, depth, store, allowed, p, take)
        frontier, depth = state.frontier(), state.depth
        made += 1
    store.close()
    return CrawlResult(state.read("log"), state.read("samples"), state.collected, state.steps,
                       depth is not None and state.collected >= p.max_samples, sum(store.runs))


def _step(state: CrawlState, frontier: DataFrame, depth: int, store: PageStore,
          allowed: DataFrame, p: HarvestParams, take: int | None) -> None:
    level = frontier.where(F.col("depth") == depth).groupBy("url", "depth").agg(
        F.min("crawl_key").alias("crawl_key"))
    level = domain_allowed(level, "url", allowed)
    level = materialise(not_visited(level, "url", state.visited.may_match(level.select("url"), state.steps)), "frontier-level")
    now = level
    if take is not None:
        now = materialise(_prefix(level, level.count(), take), "frontier-prefix")
        store.reduce_some(now)
    facts = store.fetch(now.select("url"), ["page_id", "gate_reason", "_nchunks", "_dig", "_bkeys"])
    # URLs with no page row (or empty HTML) are fetch_failed
    rows = cut_lineage(now.join(facts, "url", "left").withColumns({
        "gate_reason": F.coalesce("gate_reason", F.lit("fetch_failed")),
        "_nchunks": F.coalesce("_nchunks", F.lit(0).cast("bigint"))}))
    sigs = rows.where("gate_reason = 'pass'").select(
        F.col("url").alias("_id"), F.col("crawl_key").alias("_ord"), "_dig", "_bkeys")
    own = explode_bands(sigs).select(F.col("_band").alias("band"), F.col("_bkey").alias("bkey"))
    verdict, buckets = greedy_dedup_sigs(sigs, prior_buckets=state.buckets.may_match(own, state.steps), with_buckets=True)
    kept = F.coalesce(F.col("keep"), F.lit(False))
    decided = rows.join(verdict.withColumnRenamed("_id", "url"), "url", "left").select(
        "url", "depth", "crawl_key", "page_id",
        F.when(F.col("gate_reason") != "pass", F.col("gate_reason"))
        .when(kept, F.lit("kept")).otherwise(F.lit("duplicate")).alias("gate_reason"),
        F.when(kept, F.col("_nchunks")).otherwise(F.lit(0).cast("bigint")).alias("n_samples"))
    # O2: the budget's cut in crawl order
    before = running_sum(decided.select("url", "crawl_key", "n_samples"), ["crawl_key"], "n_samples", "_cum")
    before = before.select("url", (F.lit(state.collected) + F.col("_cum") - F.col("n_samples")).alias("_before"))
    decided = cut_lineage(decided.join(before, "url").withColumn("_ok", F.col("_before") < F.lit(p.max_samples)))
    done = state.write("log", decided.where("_ok"))
    totals = done.agg(F.sum("n_samples"), F.count(F.lit(1)), F.count_if(F.col("gate_reason") == "kept")).first()
    collected = state.collected + (totals[0] or 0)
    good = store.fetch(done.where("gate_reason = 'kept'").select("url", "crawl_key"), ["text", "hrefs"])
    chunks = chunk(good.select("url", "text"), "text", p, keep=["url"])
    state.write("samples", chunks.select(
        "url", "chunk_no",
        instruction(F.col("url"), F.col("chunk_no"), netloc(F.col("url")), p.templates, p.seed)
        .alias("instruction"),
        source_tag(F.col("url")).alias("input"), F.col("chunk").alias("output")))
    # buckets of kept documents are distinct: of two that share one, the later is a duplicate
    state.buckets.write(state.steps, buckets.join(done.select(F.col("url").alias("_id")), "_id", "left_semi"),
                        totals[2] * p.bands)
    # L1 on processed kept pages only
    raw = good.select(
        F.col("url").alias("_base"), "crawl_key", F.posexplode("hrefs").alias("link_pos", "_href"))
    links = resolved(with_url_join(raw, "_base", "_href", "link").select("link", "crawl_key", "link_pos"))
    links = domain_allowed(links, "link", allowed)
    # repeated links collapse map-side before the visited set is joined
    links = links.groupBy(F.col("link").alias("url")).agg(F.min(F.concat(
        F.col("crawl_key"), F.array(F.col("link_pos").cast("bigint")))).alias("crawl_key"))
    links = not_visited(not_visited(links, "url", state.visited.may_match(links.select("url"), state.steps)), "url", done)
    state.visited.write(state.steps, done.select("url"), totals[1])
    waiting = level.join(done.select("url"), "url", "left_anti").select("url", "depth", "crawl_key")
    queue = frontier.where(F.col("depth") > depth).unionByName(waiting).unionByName(
        links.select("url", F.lit(depth + 1).alias("depth"), "crawl_key"))
    first = queue.groupBy("url").agg(F.min(F.struct("depth", "crawl_key")).alias("_k"))
    queue = state.write("frontier", first.select("url", "_k.depth", "_k.crawl_key"))
    state.commit(collected, queue.agg(F.min("depth")).first()[0], state.processed + totals[1])
    log.info("crawl step %d at depth %d: %d samples so far", state.steps, depth, collected)


def default_crawl(pages: DataFrame, p: HarvestParams = HarvestParams(),
                  state_dir: str | None = None) -> CrawlResult:
    """G1 from the default seeds under the default allow-list."""
    spark = pages.sparkSession
    return crawl(default_seeds(spark), default_domains(spark), pages, p, state_dir)
