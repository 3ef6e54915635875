"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole given tables.  Column names equal the oracle SQL's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions.minhash import band_keys, jaccard_estimate as jaccard, signature
from .functions.text import ws_tokens
from .operators import dedup
from .operators.chunk import chunk
from .plans.documents import DOC_PARAMS, document_reasons, document_samples
from .session import ensure_checkpoint_dir, materialise, read_table, spread
from .functions.html import main_text
from .functions.url import netloc
from .operators.links import discover_links, page_links


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spread(read_table(spark, sf_dir, "documents"))


def q_chunk_fold(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return chunk(docs, "text", DOC_PARAMS, keep=["doc_id"])


def q_instruction_samples(spark, sf_dir):
    return document_samples(_docs(spark, sf_dir), DOC_PARAMS, dedup=False).drop("source")


def q_harvest_documents(spark, sf_dir):
    return document_samples(_docs(spark, sf_dir), DOC_PARAMS, dedup=True).drop("source")


def q_gate_report(spark, sf_dir):
    r = document_reasons(_docs(spark, sf_dir), DOC_PARAMS, dedup=True)
    return r.groupBy("source", "gate_reason").agg(F.count(F.lit(1)).alias("n"))


def q_minhash_signature(spark, sf_dir):
    p = DOC_PARAMS
    d = _docs(spark, sf_dir).select("doc_id", "text")
    s = d.select("doc_id",
                 F.size(F.array_distinct(ws_tokens(F.col("text")))).cast("bigint").alias("n_tokens"),
                 signature(F.col("text"), p.num_perm).alias("sig"))
    return s.select(
        "doc_id", "n_tokens",
        F.md5(F.array_join(F.col("sig").cast("array<string>"), ",")).alias("sig_digest"),
        F.element_at(band_keys(F.col("sig"), p.bands, p.rows), 1).alias("band0"))


def q_lsh_candidates(spark, sf_dir):
    return dedup.lsh_candidates(_docs(spark, sf_dir), "doc_id", "text", DOC_PARAMS)


def q_greedy_dedup(spark, sf_dir):
    return dedup.greedy_dedup_docs(_docs(spark, sf_dir), "doc_id", "text", DOC_PARAMS)


def q_jaccard_estimate(spark, sf_dir):
    """X9 between every document and its first LSH candidate; signatures are
    computed once and reused for both the candidates and the estimate."""
    p = DOC_PARAMS
    d = _docs(spark, sf_dir).select("doc_id", "text")
    sig = materialise(d.select("doc_id", signature(F.col("text"), p.num_perm).alias("sig")), "signatures")
    members = sig.select(F.col("doc_id").alias("_id"), F.col("doc_id").alias("_ord"),
                         F.posexplode(band_keys(F.col("sig"), p.bands, p.rows))
                         .alias("_band", "_bkey"))
    cand = dedup.candidates_from_members(members, "doc_id").where(
        F.col("first_candidate").isNotNull())
    a = sig.alias("a")
    b = sig.alias("b")
    return (cand.join(a, "doc_id")
            .join(b, F.col("first_candidate") == F.col("b.doc_id"))
            .select(F.col("a.doc_id").alias("doc_id"),
                    F.col("first_candidate").alias("candidate_id"),
                    jaccard(F.col("a.sig"), F.col("b.sig")).alias("jaccard_est")))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spread(read_table(spark, sf_dir, "pages"))


def q_url_netloc(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "url", netloc(F.col("url")).alias("netloc"))


def q_main_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", main_text(F.col("html")).alias("text"))


def q_link_discovery(spark, sf_dir):
    """Links of all pages.  Allowed are the hosts that serve a page over https;
    visited are all pages and the links found on pages fetched over https."""
    pages = _pages(spark, sf_dir).select("page_id", "url", "html")
    https = F.startswith(F.col("url"), F.lit("https:"))
    hosts = pages.where(https).select(netloc(F.col("url")).alias("domain"))
    seen = pages.select("url").union(page_links(pages.where(https), []).select("link"))
    return discover_links(pages, ["page_id"], hosts, visited=seen)


QUERIES = {
    "harvest_documents": q_harvest_documents,
    "chunk_fold": q_chunk_fold,
    "instruction_samples": q_instruction_samples,
    "gate_report": q_gate_report,
    "minhash_signature": q_minhash_signature,
    "lsh_candidates": q_lsh_candidates,
    "greedy_dedup": q_greedy_dedup,
    "jaccard_estimate": q_jaccard_estimate,
}

def _harvest_samples(spark, sf_dir):
    """Harvest samples with a sample_id key (doc_id:chunk_no)."""
    s = document_samples(_docs(spark, sf_dir), DOC_PARAMS, dedup=True)
    return s.withColumn("sample_id", F.concat_ws(":", "doc_id", "chunk_no"))


def _split(spark, sf_dir):
    from .operators.train_prep import train_test_split
    return train_test_split(_harvest_samples(spark, sf_dir), "sample_id")


def q_train_test_split(spark, sf_dir):
    return _split(spark, sf_dir).select("sample_id", "split_hash", "split")


def q_render_samples(spark, sf_dir):
    from .functions.chat import render_sample
    s = _harvest_samples(spark, sf_dir)
    return s.select("sample_id", render_sample(F.col("instruction"), F.col("input"),
                                               F.col("output")).alias("text"))


def q_pack_blocks(spark, sf_dir):
    """T1 over the train split.  The lengths of all samples are written, so that the split and the
    packing read narrow rows and the texts are cut once."""
    from .operators.train_prep import pack_blocks, train_test_split, training_lengths
    lengths = materialise(training_lengths(_harvest_samples(spark, sf_dir), ["sample_id"], DOC_PARAMS), "sample-lengths")
    train = train_test_split(lengths, "sample_id").where(F.col("split") == "train")
    return pack_blocks(train, "sample_id", ["split_hash", "sample_id"], "n_tok")


def q_sample_counts(spark, sf_dir):
    s = _harvest_samples(spark, sf_dir)
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n_samples"))


def q_jsonl_round_trip(spark, sf_dir):
    from .session import scratch_path
    from .sources.samples_io import read_samples, write_samples
    path = scratch_path(spark, "samples-jsonl")
    write_samples(_harvest_samples(spark, sf_dir), path, mode="overwrite")
    return read_samples(spark, path).select("instruction", "input", "output")


def q_sample_contract(spark, sf_dir):
    from .operators.contract import RULES, contract_checks
    from .sources.samples_io import to_json_line
    lines = to_json_line(_harvest_samples(spark, sf_dir))
    return contract_checks(lines).select("sample_id", "n_keys", *RULES)


def q_contract_violations(spark, sf_dir):
    """V1 on lines made from every sample, most of which break one rule: by the
    hash of its id a line is right, lacks a key, has one too many, a number for a
    text, another source tag, blanks between its parts, no JSON, or a topic of
    two lines."""
    from .operators.contract import contract_checks, violations
    s = _harvest_samples(spark, sf_dir)
    kind = F.conv(F.substring(F.md5("sample_id"), 1, 4), 16, 10).cast("int") % 8
    text = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    plain = F.to_json(F.struct("instruction", "input", "output"))
    line = (F.when(kind == 1, F.to_json(F.struct("instruction", "input")))
            .when(kind == 2, F.to_json(F.struct("instruction", "input", "output", "source")))
            .when(kind == 3, F.to_json(F.struct("instruction", "input", F.length("output").alias("output"))))
            .when(kind == 4, F.to_json(F.struct("instruction", F.concat(F.lit("From: "), "source").alias("input"), "output")))
            .when(kind == 5, F.concat(F.lit('{ "output" : '), text("output"), F.lit(' , "input" : '), text("input"),
                                      F.lit(' ,\n "instruction" : '), text("instruction"), F.lit(" }")))
            .when(kind == 6, F.concat(F.lit("no json: "), "sample_id"))
            .when(kind == 7, F.to_json(F.struct(F.replace("instruction", "source", F.concat("source", F.lit("\nb")))
                                                .alias("instruction"), "input", "output")))
            .otherwise(plain))
    return violations(contract_checks(s.select("sample_id", line.alias("line"))), ["sample_id"])


def q_card_stats(spark, sf_dir):
    from .operators.contract import card_stats
    return card_stats(_split(spark, sf_dir).select("split", "source"), "source")


def _conversations(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    return read_table(spark, sf_dir, "conversations")


def q_render_conversations(spark, sf_dir):
    from .operators.chat import assemble_conversations
    return assemble_conversations(_conversations(spark, sf_dir))


def q_prompt_table(spark, sf_dir):
    from .operators.chat import prompt_table
    users = _conversations(spark, sf_dir).where(F.col("role") == "user")
    return prompt_table(users, ["conv_id", "turn"], "text")


def q_evaluation_prompts(spark, sf_dir):
    from .operators.chat import evaluation_prompts
    return evaluation_prompts(_conversations(spark, sf_dir))


#: sample budget of the sample_budget query, below what the pages yield
BUDGET = 20


def _page_crawl(spark, sf_dir, max_samples):
    """Every page a seed, in page_id order; allowed are all hosts of the table."""
    from .params import HarvestParams
    from .plans.crawl import crawl
    pages = _pages(spark, sf_dir)
    seeds = pages.select(F.col("page_id").alias("pos"), "url")
    hosts = pages.select(netloc(F.col("url")).alias("domain"))
    return crawl(seeds, hosts, pages, HarvestParams(max_samples=max_samples))


def _whole_crawl(spark, sf_dir):
    from .plans.crawl import UNSPENT
    return _page_crawl(spark, sf_dir, UNSPENT)


def q_crawl_closure(spark, sf_dir):
    return _whole_crawl(spark, sf_dir).log.select(
        "url", "depth", F.array_join(F.col("crawl_key").cast("array<string>"), ".").alias("crawl_key"),
        "page_id", "gate_reason", "n_samples")


def q_page_gate_report(spark, sf_dir):
    """A3 for pages: all URLs of the whole crawl per (host, reason)."""
    return _whole_crawl(spark, sf_dir).log.groupBy(
        netloc(F.col("url")).alias("netloc"), "gate_reason").agg(F.count(F.lit(1)).alias("n"))


def q_sample_budget(spark, sf_dir):
    """O2: the URLs processed until the budget is spent."""
    return _page_crawl(spark, sf_dir, BUDGET).log.select("url", "page_id", "gate_reason", "n_samples")


def _stream(spark, sf_dir, jsonl=None):
    """The pages as a stream that grows by a folder of files a run, one for each batch, in page_id
    order; each repeats the last one's pages.  Allowed are https hosts.  Returns its folder."""
    from .session import scratch_path
    from .streaming.incremental import start_incremental_harvest
    out, files = scratch_path(spark, "stream-harvest"), scratch_path(spark, "stream-pages")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    hosts = pages.where(F.startswith("url", F.lit("https:"))).select(netloc(F.col("url")).alias("domain"))
    cuts = pages.approxQuantile("page_id", [k / STREAM_FILES for k in range(1, STREAM_FILES)], 0.01)
    part = F.lit(0)
    for cut in cuts:        # null ids come last
        part = part + (F.coalesce(F.col("page_id") > cut, F.lit(True))).cast("int")
    for k in range(STREAM_FILES):
        pages.where((part == k) | (part == k - 1)).write.parquet(f"{files}/part={k}")
        q = start_incremental_harvest(spark, f"{files}/*", out, domains=hosts, jsonl=jsonl, max_files_per_trigger=100_000)
        q.awaitTermination()
    return out


def q_stream_harvest(spark, sf_dir):
    from .streaming.incremental import read_samples_sink
    return read_samples_sink(spark, _stream(spark, sf_dir)).select("url", "chunk_no", "instruction", "input", "output")


def q_stream_decisions(spark, sf_dir):
    """A3 of the stream: what became of each page when it first arrived.  A URL that an earlier
    batch has seen counts as repeated, as it would in one batch."""
    from .streaming.incremental import read_sink
    log = read_sink(spark, _stream(spark, sf_dir), "decisions").groupBy("page_id", "url").agg(
        F.min_by(F.struct("gate_reason", "n_samples"), "batch_id").alias("d"))
    return log.select("page_id", "url", F.when(F.col("d.gate_reason") == "seen", F.lit("repeated")).otherwise(
        F.col("d.gate_reason")).alias("gate_reason"), "d.n_samples")


def q_stream_jsonl(spark, sf_dir):
    """S3/S4 of the stream: its samples by the JSON lines of committed batches."""
    from .session import scratch_path
    from .sources.samples_io import read_batches
    path = scratch_path(spark, "stream-jsonl")
    _stream(spark, sf_dir, path)
    return read_batches(spark, path).select("instruction", "input", "output")


def q_bytes_pages(spark, sf_dir):
    """every page as bytes, by a hash of its id in UTF-8 without and with mark, UTF-16 of
    either order, Latin-1 named by a meta element (where it can be), or broken."""
    from .plans.crawl import page_rows
    pages = _pages(spark, sf_dir)
    kind = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 2), 16, 10).cast("int") % 6
    latin = ~F.rlike("html", F.lit("[^\\x00-\\x7F\\xA0-\\xFF]"))
    marked = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode("html", charset))
    payload = (F.when(kind == 1, marked("EFBBBF", "UTF-8")).when(kind == 2, marked("FFFE", "UTF-16LE"))
               .when(kind == 3, marked("FEFF", "UTF-16BE"))
               .when((kind == 4) & latin, F.encode(F.concat(F.lit('<meta charset="latin1">'), "html"), "ISO-8859-1"))
               .when(kind == 5, F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("FF"))))
               .otherwise(F.encode("html", "UTF-8")))
    return page_rows(pages.select("page_id", "url", payload.alias("html"))).select("page_id", "gate_reason", "text")


def q_group_split(spark, sf_dir):
    """O3 by group: all samples of a document on one side."""
    from .operators.train_prep import group_split
    return group_split(_harvest_samples(spark, sf_dir), "doc_id").select("sample_id", "doc_id", "split")


#: batches of the stream queries
STREAM_FILES = 3


QUERIES.update({
    "stream_harvest": q_stream_harvest,
    "stream_decisions": q_stream_decisions,
    "stream_jsonl": q_stream_jsonl,
    "bytes_pages": q_bytes_pages,
    "group_split": q_group_split,
    "crawl_closure": q_crawl_closure,
    "sample_budget": q_sample_budget,
    "page_gate_report": q_page_gate_report,
    "train_test_split": q_train_test_split,
    "render_samples": q_render_samples,
    "pack_blocks": q_pack_blocks,
    "sample_counts": q_sample_counts,
    "jsonl_round_trip": q_jsonl_round_trip,
    "sample_contract": q_sample_contract,
    "contract_violations": q_contract_violations,
    "evaluation_prompts": q_evaluation_prompts,
    "render_conversations": q_render_conversations,
    "prompt_table": q_prompt_table,
    "card_stats": q_card_stats,
})

QUERIES.update({
    "url_netloc": q_url_netloc,
    "main_text": q_main_text,
    "link_discovery": q_link_discovery,
})

ORACLES = {
    "chunk_fold": oracles.chunk_fold(),
    "instruction_samples": oracles.instruction_samples(),
    "gate_report": oracles.gate_report(),
    "minhash_signature": oracles.minhash_signature(),
    "lsh_candidates": oracles.lsh_candidates(),
    "greedy_dedup": oracles.greedy_dedup(),
    "jaccard_estimate": oracles.jaccard_estimate(),
    "url_netloc": oracles.url_netloc(),
    "main_text": oracles.main_text(),
    "link_discovery": oracles.link_discovery(),
    "harvest_documents": oracles.harvest_documents(),
    "train_test_split": oracles.train_test_split(),
    "render_samples": oracles.render_samples(),
    "pack_blocks": oracles.pack_blocks(),
    "sample_counts": oracles.sample_counts(),
    "jsonl_round_trip": oracles.jsonl_round_trip(),
    "sample_contract": oracles.sample_contract(),
    "contract_violations": oracles.contract_violations(),
    "evaluation_prompts": oracles.evaluation_prompts(),
    "crawl_closure": oracles.crawl_closure(),
    "render_conversations": oracles.render_conversations(),
    "prompt_table": oracles.prompt_table(),
    "sample_budget": oracles.sample_budget(BUDGET),
    "stream_harvest": oracles.stream_harvest(),
    "stream_decisions": oracles.stream_decisions(),
    "stream_jsonl": oracles.stream_jsonl(),
    "bytes_pages": oracles.bytes_pages(),
    "group_split": oracles.group_split(),
    "card_stats": oracles.card_stats(),
    "page_gate_report": oracles.page_gate_report(),
}
