"""DuckDB SQL spellings of the registered queries (the correctness oracle).

Each builder returns plain SQL over the pre-registered views (documents,
pages, conversations, ...).  The SQL restates the same rules as the Spark
code, written independently in DuckDB's dialect.
"""

from __future__ import annotations

from .functions.minhash import sql_band_keys, sql_signature_cte, sql_token_set_digest
from .functions.html import sql_main_text
from .functions.samples import sql_instruction
from .functions.url import sql_hrefs, sql_netloc, sql_url_join
from .functions.text import sql_str, sql_tokens
from .operators.chunk import sql_chunk_list
from .operators.gates import sql_gate_reason
from .params import HarvestParams

DOC_P = HarvestParams(sep="\n")


def chunk_fold(p: HarvestParams = DOC_P) -> str:
    return f"""
    SELECT doc_id, unnest(range(len(ch)))::BIGINT AS chunk_no, unnest(ch) AS chunk
    FROM (SELECT doc_id, {sql_chunk_list('text', p)} AS ch FROM documents)
    """


def instruction_samples(p: HarvestParams = DOC_P) -> str:
    return f"""
    WITH kept AS (
        SELECT doc_id, source, text FROM documents
        WHERE ({sql_gate_reason('text', p)}) = 'pass'
    ), ch AS (
        SELECT doc_id, source, unnest(range(len(c)))::BIGINT AS chunk_no, unnest(c) AS chunk
        FROM (SELECT doc_id, source, {sql_chunk_list('text', p)} AS c FROM kept)
    )
    SELECT doc_id, chunk_no,
           {sql_instruction('doc_id', 'chunk_no', 'source', p.templates, p.seed)} AS instruction,
           'Source: ' || source AS input,
           chunk AS output
    FROM ch
    """


def _dedup_ctes(source_sql: str, p: HarvestParams) -> str:
    """CTEs ending in ``verdict(id, keep)`` for the rows of ``source_sql``
    (columns id, text), processed in id order, sequential greedy fold."""
    keys = sql_band_keys("sig", p.bands, p.rows)
    return f"""
    src AS ({source_sql}),
    dig AS (SELECT id, text, {sql_token_set_digest('text')} AS dig FROM src),
    firsts AS (
        SELECT id, text FROM (
            SELECT id, text, min(id) OVER (PARTITION BY dig) AS first_id FROM dig)
        WHERE id = first_id),
    sig AS ({sql_signature_cte('firsts', 'id', 'text', p.num_perm)}),
    mem AS (
        SELECT id, unnest(range({p.bands})) AS band, unnest([{', '.join(keys)}]) AS bkey
        FROM sig),
    multi AS (
        SELECT band, bkey FROM mem GROUP BY band, bkey HAVING count(*) > 1),
    emem AS (SELECT m.* FROM mem m JOIN multi USING (band, bkey)),
    nodes AS (
        SELECT a.id, list(DISTINCT b.id) FILTER (WHERE b.id < a.id) AS nb
        FROM emem a JOIN emem b USING (band, bkey)
        GROUP BY a.id),
    greedy AS (
        SELECT list_reduce(
            list({{'id': id, 'nb': coalesce(nb, []::BIGINT[])}} ORDER BY id),
            lambda acc, x: CASE WHEN list_has_any(x.nb, acc) THEN acc
                                ELSE list_append(acc, x.id) END,
            []::BIGINT[]) AS kept
        FROM nodes),
    verdict AS (
        SELECT s.id,
               CASE WHEN f.id IS NULL THEN false
                    WHEN n.id IS NULL THEN true
                    ELSE list_contains((SELECT kept FROM greedy), s.id) END AS keep
        FROM src s
        LEFT JOIN firsts f ON f.id = s.id
        LEFT JOIN nodes n ON n.id = s.id)
    """


def greedy_dedup(p: HarvestParams = DOC_P) -> str:
    return f"""
    WITH {_dedup_ctes("SELECT doc_id AS id, text FROM documents", p)}
    SELECT id AS doc_id, keep FROM verdict
    """


def gate_report(p: HarvestParams = DOC_P) -> str:
    return f"""
    WITH reasons AS (
        SELECT doc_id, source, text, {sql_gate_reason('text', p)} AS r FROM documents
    ),
    {_dedup_ctes("SELECT doc_id AS id, text FROM reasons WHERE r = 'pass'", p)}
    SELECT source, gate_reason, count(*) AS n FROM (
        SELECT r0.source,
               CASE WHEN r0.r <> 'pass' THEN r0.r
                    WHEN v.keep THEN 'kept' ELSE 'duplicate' END AS gate_reason
        FROM reasons r0 LEFT JOIN verdict v ON v.id = r0.doc_id)
    GROUP BY source, gate_reason
    """


def minhash_signature(p: HarvestParams = DOC_P) -> str:
    return f"""
    WITH sig AS ({sql_signature_cte('documents', 'doc_id', 'text', p.num_perm)})
    SELECT d.doc_id,
           len(list_distinct({sql_tokens('d.text')}))::BIGINT AS n_tokens,
           md5(array_to_string(s.sig, ',')) AS sig_digest,
           {sql_band_keys('s.sig', p.bands, p.rows)[0]} AS band0
    FROM documents d JOIN sig s ON s.doc_id = d.doc_id
    """


def _members_sql(p: HarvestParams) -> str:
    keys = sql_band_keys("sig", p.bands, p.rows)
    return f"""
    sig AS ({sql_signature_cte('documents', 'doc_id', 'text', p.num_perm)}),
    mem AS (
        SELECT doc_id AS id, unnest(range({p.bands})) AS band,
               unnest([{', '.join(keys)}]) AS bkey
        FROM sig)
    """


def lsh_candidates(p: HarvestParams = DOC_P) -> str:
    return f"""
    WITH {_members_sql(p)},
    pairs AS (
        SELECT a.id, a.band, b.id AS other
        FROM mem a JOIN mem b ON a.band = b.band AND a.bkey = b.bkey AND a.id <> b.id)
    SELECT m.id AS doc_id,
           (SELECT min(other) FROM pairs q WHERE q.id = m.id) AS first_candidate,
           (SELECT count(DISTINCT band) FROM pairs q WHERE q.id = m.id AND q.other < m.id)::BIGINT
               AS n_bands_hit
    FROM (SELECT DISTINCT id FROM mem) m
    """


def jaccard_estimate(p: HarvestParams = DOC_P) -> str:
    return f"""
    WITH {_members_sql(p)},
    cand AS (
        SELECT a.id, min(b.id) AS other
        FROM mem a JOIN mem b ON a.band = b.band AND a.bkey = b.bkey AND a.id <> b.id
        GROUP BY a.id)
    SELECT c.id AS doc_id, c.other AS candidate_id,
           (len(list_filter(list_zip(s1.sig, s2.sig), lambda z: z[1] = z[2]))::DOUBLE
            / {p.num_perm}::DOUBLE) AS jaccard_est
    FROM cand c JOIN sig s1 ON s1.doc_id = c.id JOIN sig s2 ON s2.doc_id = c.other
    """


def url_netloc() -> str:
    return f"SELECT page_id, url, {sql_netloc('url')} AS netloc FROM pages"


def main_text() -> str:
    return f"SELECT page_id, {sql_main_text('html')} AS text FROM pages"


def _links_cte(source: str, keys: str) -> str:
    """Relation of the resolved links of ``source`` (keys, url, html)."""
    raw = f"""(SELECT {keys}, url AS _base, unnest(range(len(h)))::BIGINT AS link_pos,
                      unnest(h) AS _href
               FROM (SELECT {keys}, url, {sql_hrefs('html')} AS h FROM {source}))"""
    return sql_url_join(raw, '_base', '_href', 'link')


def link_discovery() -> str:
    return f"""
    WITH j AS {_links_cte('pages', 'page_id')},
    hosts AS (SELECT DISTINCT {sql_netloc('url')} AS domain FROM pages WHERE url LIKE 'https:%'),
    seen AS (SELECT url FROM pages UNION SELECT link FROM j WHERE _base LIKE 'https:%')
    SELECT page_id, link_pos, link FROM j
    WHERE {sql_netloc('link')} IN (SELECT domain FROM hosts)
      AND link NOT IN (SELECT url FROM seen WHERE url IS NOT NULL)
    """


# --- harvest samples and what is derived from them -------------------------

def _harvest_ctes(p: HarvestParams = DOC_P) -> str:
    """CTEs ending in ``samples(sample_id, doc_id, chunk_no, source,
    instruction, input, output)``."""
    return f"""
    reasons AS (
        SELECT doc_id, source, text, {sql_gate_reason('text', p)} AS r FROM documents),
    {_dedup_ctes("SELECT doc_id AS id, text FROM reasons WHERE r = 'pass'", p)},
    kept AS (
        SELECT r0.doc_id, r0.source, r0.text FROM reasons r0
        JOIN verdict v ON v.id = r0.doc_id AND v.keep),
    ch AS (
        SELECT doc_id, source, unnest(range(len(c)))::BIGINT AS chunk_no, unnest(c) AS chunk
        FROM (SELECT doc_id, source, {sql_chunk_list('text', p)} AS c FROM kept)),
    samples AS (
        SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_no AS VARCHAR) AS sample_id,
               doc_id, chunk_no, source,
               {sql_instruction('doc_id', 'chunk_no', 'source', p.templates, p.seed)} AS instruction,
               'Source: ' || source AS input,
               chunk AS output
        FROM ch)
    """


def harvest_documents(p: HarvestParams = DOC_P) -> str:
    return f"""WITH {_harvest_ctes(p)}
    SELECT doc_id, chunk_no, instruction, input, output FROM samples"""


def _split_ctes(p: HarvestParams = DOC_P, seed: int = 42) -> str:
    return f"""{_harvest_ctes(p)},
    hashed AS (
        SELECT *, md5('{seed}' || '#' || sample_id) AS split_hash FROM samples),
    ranked AS (
        SELECT *, row_number() OVER (ORDER BY split_hash, sample_id) AS r,
               count(*) OVER () AS n FROM hashed),
    split AS (
        SELECT *, CASE WHEN r <= (n + 9) // 10 THEN 'test' ELSE 'train' END AS split
        FROM ranked)
    """


def train_test_split(p: HarvestParams = DOC_P) -> str:
    return f"""WITH {_split_ctes(p)}
    SELECT sample_id, split_hash, split FROM split"""


def render_samples(p: HarvestParams = DOC_P) -> str:
    from .functions.chat import sql_render_sample
    return f"""WITH {_harvest_ctes(p)}
    SELECT sample_id, {sql_render_sample('instruction', 'input', 'output')} AS text FROM samples"""


def pack_blocks(p: HarvestParams = DOC_P, block: int = 2048) -> str:
    from .functions.chat import sql_render_sample
    text = sql_render_sample('instruction', 'input', 'output')
    return f"""WITH {_split_ctes(p)},
    tr AS (
        SELECT sample_id, split_hash, len({sql_tokens(text)})::BIGINT + 1 AS len
        FROM split WHERE split = 'train'),
    c AS (
        SELECT sample_id, len,
               (sum(len) OVER (ORDER BY split_hash, sample_id ROWS UNBOUNDED PRECEDING))::BIGINT AS e
        FROM tr),
    seg AS (
        SELECT sample_id, len, e, e - len AS s,
               unnest(range((e - len) // {block}, (e - 1) // {block} + 1)) AS block_id
        FROM c)
    SELECT block_id::BIGINT AS block_id, sample_id,
           (greatest(s, block_id * {block}) - s)::BIGINT AS from_tok,
           (least(e, (block_id + 1) * {block}) - s)::BIGINT AS to_tok
    FROM seg
    WHERE block_id < (SELECT coalesce(max(e), 0) FROM c) // {block}
    """


def sample_counts(p: HarvestParams = DOC_P) -> str:
    return f"""WITH {_harvest_ctes(p)}
    SELECT source, count(*) AS n_samples FROM samples GROUP BY source"""


def jsonl_round_trip(p: HarvestParams = DOC_P) -> str:
    return f"""WITH {_harvest_ctes(p)}
    SELECT instruction, input, output FROM samples"""


def _contract_ctes(lines: str) -> str:
    """CTEs ending in ``checked`` over ``lines`` (sample_id, line)."""
    from .operators.contract import template_regex
    return f"""
    lines AS ({lines}),
    docs AS (SELECT sample_id, TRY_CAST(line AS JSON) AS j FROM lines),
    objects AS (SELECT sample_id, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j FROM docs),
    checked AS (
        SELECT sample_id, coalesce(len(json_keys(j)), 0)::BIGINT AS n_keys,
               coalesce(list_sort(json_keys(j)) = ['input', 'instruction', 'output'], false) AS keys_ok,
               coalesce(list_sort(json_keys(j)) = ['input', 'instruction', 'output']
                        AND json_type(j, '$.input') = 'VARCHAR' AND json_type(j, '$.output') = 'VARCHAR'
                        AND json_type(j, '$.instruction') = 'VARCHAR', false) AS types_ok,
               coalesce(starts_with(j ->> '$.input', 'Source: '), false) AS input_ok,
               coalesce(regexp_matches(j ->> '$.instruction', {sql_str(template_regex())}), false)
                   AS instruction_ok,
               coalesce((j ->> '$.instruction') IS NOT NULL AND (j ->> '$.input') IS NOT NULL
                        AND (j ->> '$.output') IS NOT NULL, false) AS round_trip_ok
        FROM objects)
    """


def sample_contract(p: HarvestParams = DOC_P) -> str:
    lines = """SELECT sample_id, to_json({'instruction': instruction, 'input': input, 'output': output})::VARCHAR
               AS line FROM samples"""
    return f"""WITH {_harvest_ctes(p)}, {_contract_ctes(lines)} SELECT * FROM checked"""


def contract_violations(p: HarvestParams = DOC_P) -> str:
    lines = """
        SELECT sample_id, CASE ('0x' || substr(md5(sample_id), 1, 4))::INT % 8
          WHEN 1 THEN to_json({'instruction': instruction, 'input': input})::VARCHAR
          WHEN 2 THEN to_json({'instruction': instruction, 'input': input, 'output': output, 'source': source})::VARCHAR
          WHEN 3 THEN to_json({'instruction': instruction, 'input': input, 'output': length(output)})::VARCHAR
          WHEN 4 THEN to_json({'instruction': instruction, 'input': 'From: ' || source, 'output': output})::VARCHAR
          WHEN 5 THEN '{ "output" : ' || to_json(output)::VARCHAR || ' , "input" : ' || to_json(input)::VARCHAR
                      || ' , "instruction" : ' || to_json(instruction)::VARCHAR || ' }'
          WHEN 6 THEN 'no json: ' || sample_id
          WHEN 7 THEN to_json({'instruction': replace(instruction, source, source || chr(10) || 'b'),
                               'input': input, 'output': output})::VARCHAR
          ELSE to_json({'instruction': instruction, 'input': input, 'output': output})::VARCHAR END AS line
        FROM samples"""
    rules = ["keys_ok", "types_ok", "input_ok", "instruction_ok", "round_trip_ok"]
    failed = " UNION ALL ".join(f"SELECT sample_id, '{r}' AS rule FROM checked WHERE NOT {r}" for r in rules)
    return f"""WITH {_harvest_ctes(p)}, {_contract_ctes(lines)} {failed}"""


def evaluation_prompts() -> str:
    from .functions.chat import sql_generation_prompt, sql_message
    from .params import BEGIN_OF_TEXT, SERVING_SYSTEM_PROMPT
    from .sources.prompts import prompt_sets
    rows = ", ".join(f"({sql_str(s)}, {i}, {sql_str(t)}, {sql_str(y) if y else 'NULL'})"
                     for s, i, t, y in prompt_sets())
    system = f"coalesce(nullif(coalesce(q.system, c.own), ''), {sql_str(SERVING_SYSTEM_PROMPT)})"
    return f"""
    WITH q(prompt_set, prompt_id, text, system) AS (VALUES {rows}),
    c AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system' AND text <> '') AS own
          FROM conversations GROUP BY conv_id)
    SELECT c.conv_id, q.prompt_set, q.prompt_id,
           {sql_str(BEGIN_OF_TEXT)} || {sql_message("'system'", system)}
           || {sql_message("'user'", 'q.text')} || {sql_generation_prompt()} AS prompt
    FROM c, q"""


def render_conversations() -> str:
    from .functions.chat import sql_message
    from .functions.text import sql_strip
    from .params import BEGIN_OF_TEXT, SERVING_SYSTEM_PROMPT
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, {sql_message('role', 'text')} AS blk FROM conversations
        WHERE role <> 'system' AND (role <> 'assistant' OR coalesce({sql_strip('text')} <> '', false))),
    body AS (
        SELECT conv_id, string_agg(blk, '' ORDER BY turn) AS body, count(*) AS n
        FROM turns GROUP BY conv_id),
    sys AS (
        SELECT conv_id, arg_min(text, turn) AS s FROM conversations
        WHERE role = 'system' AND text <> '' GROUP BY conv_id),
    convs AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT c.conv_id, (coalesce(b.n, 0) + 1)::BIGINT AS n_messages,
           {sql_str(BEGIN_OF_TEXT)} ||
           {sql_message("'system'", f"coalesce(nullif(s.s, ''), {sql_str(SERVING_SYSTEM_PROMPT)})")}
           || coalesce(b.body, '') AS prompt
    FROM convs c LEFT JOIN body b USING (conv_id) LEFT JOIN sys s USING (conv_id)
    """


def prompt_table() -> str:
    from .functions.chat import sql_generation_prompt, sql_message
    from .functions.text import sql_strip
    from .params import BEGIN_OF_TEXT, SERVING_SYSTEM_PROMPT
    return f"""
    SELECT conv_id, turn,
           {sql_str(BEGIN_OF_TEXT)} || {sql_message("'system'", sql_str(SERVING_SYSTEM_PROMPT))}
           || {sql_message("'user'", 'text')} || {sql_generation_prompt()} AS prompt
    FROM conversations
    WHERE role = 'user' AND coalesce({sql_strip('text')} <> '', false)
    """


def _page_crawl_ctes(p: HarvestParams, budget: int | None) -> str:
    """CTEs ending in ``crawled``: the crawl whose seeds are all pages in page_id
    order and whose allow-list is their hosts.  Depth 0 are the pages; depth 1 the
    links of kept pages that are no pages, which can't be fetched and so end there."""
    in_budget = f"c - n_samples < {budget}" if budget is not None else "true"
    unspent = f"(SELECT coalesce(sum(n_samples), 0) FROM done) < {budget}" if budget is not None else "true"
    return f"""
    pg AS (
        SELECT page_id, url, html FROM (
            SELECT *, min(page_id) OVER (PARTITION BY url) AS m FROM pages) WHERE page_id = m),
    tx AS (
        SELECT page_id, url, html, {sql_main_text('html')} AS text FROM pg),
    reasons AS (
        SELECT page_id, text,
               CASE WHEN html IS NULL OR html = '' THEN 'fetch_failed'
                    ELSE {sql_gate_reason('text', p)} END AS r
        FROM tx),
    {_dedup_ctes("SELECT page_id AS id, text FROM reasons WHERE r = 'pass'", p)},
    fin AS (
        SELECT r0.page_id,
               CASE WHEN r0.r <> 'pass' THEN r0.r WHEN v.keep THEN 'kept' ELSE 'duplicate' END
                   AS gate_reason,
               r0.text
        FROM reasons r0 LEFT JOIN verdict v ON v.id = r0.page_id),
    cnt AS (
        SELECT page_id, gate_reason,
               CASE WHEN gate_reason = 'kept' THEN len({sql_chunk_list('text', p)})
                    ELSE 0 END::BIGINT AS n_samples
        FROM fin),
    cum AS (
        SELECT *, sum(n_samples) OVER (ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS c FROM cnt),
    done AS (SELECT * FROM cum WHERE {in_budget}),
    harvested AS (
        SELECT page_id, url, html FROM pg JOIN done USING (page_id) WHERE gate_reason = 'kept'),
    j AS {_links_cte('harvested', 'page_id')},
    next AS (
        SELECT link AS url, min([page_id, link_pos]) AS k FROM j
        WHERE {sql_netloc('link')} IN (SELECT {sql_netloc('url')} FROM pages)
          AND link NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) AND {unspent}
        GROUP BY link),
    crawled AS (
        SELECT url, 0 AS depth, page_id::VARCHAR AS crawl_key, page_id, gate_reason, n_samples
        FROM done JOIN pg USING (page_id)
        UNION ALL
        SELECT url, 1, k[1]::VARCHAR || '.' || k[2]::VARCHAR, NULL, 'fetch_failed', 0::BIGINT FROM next)
    """


def crawl_closure(p: HarvestParams = HarvestParams()) -> str:
    return f"""WITH {_page_crawl_ctes(p, None)} SELECT * FROM crawled"""


def sample_budget(budget: int, p: HarvestParams = HarvestParams()) -> str:
    return f"""WITH {_page_crawl_ctes(p, budget)}
    SELECT url, page_id, gate_reason, n_samples FROM crawled"""


def page_gate_report(p: HarvestParams = HarvestParams()) -> str:
    return f"""WITH {_page_crawl_ctes(p, None)}
    SELECT {sql_netloc('url')} AS netloc, gate_reason, count(*) AS n
    FROM crawled GROUP BY 1, 2"""


def _stream_ctes(p: HarvestParams) -> str:
    """CTEs ending in ``ch(url, chunk_no, chunk)``: batch equivalent of the incremental harvest,
    whose files come in page_id order."""
    return f"""
    hosts AS (SELECT {sql_netloc('url')} AS h FROM pages WHERE url LIKE 'https:%'),
    pg AS (
        SELECT page_id, url, html FROM (
            SELECT *, min(page_id) OVER (PARTITION BY url) AS m FROM pages
            WHERE {sql_netloc('url')} IN (SELECT h FROM hosts))
        WHERE page_id = m),
    tx AS (SELECT page_id, url, html, {sql_main_text('html')} AS text FROM pg),
    reasons AS (
        SELECT page_id, url, text,
               CASE WHEN html IS NULL OR html = '' THEN 'fetch_failed'
                    ELSE {sql_gate_reason('text', p)} END AS r
        FROM tx),
    {_dedup_ctes("SELECT page_id AS id, text FROM reasons WHERE r = 'pass'", p)},
    kept AS (
        SELECT r0.url, r0.text FROM reasons r0 JOIN verdict v ON v.id = r0.page_id AND v.keep),
    ch AS (
        SELECT url, unnest(range(len(c)))::BIGINT AS chunk_no, unnest(c) AS chunk
        FROM (SELECT url, {sql_chunk_list('text', p)} AS c FROM kept))
    """


def stream_harvest(p: HarvestParams = HarvestParams()) -> str:
    return f"""
    WITH {_stream_ctes(p)}
    SELECT url, chunk_no,
           {sql_instruction('url', 'chunk_no', sql_netloc('url'), p.templates, p.seed)} AS instruction,
           'Source: ' || url AS input, chunk AS output
    FROM ch
    """


def stream_jsonl(p: HarvestParams = HarvestParams()) -> str:
    return f"SELECT instruction, input, output FROM ({stream_harvest(p)})"


def stream_decisions(p: HarvestParams = HarvestParams()) -> str:
    return f"""
    WITH {_stream_ctes(p)},
    n AS (SELECT url, count(*) AS n FROM ch GROUP BY url)
    SELECT page_id, url, gate_reason, n_samples FROM (
        SELECT pages.page_id, pages.url,
               CASE WHEN {sql_netloc('pages.url')} NOT IN (SELECT h FROM hosts) THEN 'not_allowed'
                    WHEN r.page_id IS NULL THEN 'repeated'
                    WHEN r.r <> 'pass' THEN r.r WHEN v.keep THEN 'kept' ELSE 'duplicate' END AS gate_reason,
               CASE WHEN v.keep THEN coalesce(n.n, 0) ELSE 0 END::BIGINT AS n_samples
        FROM pages LEFT JOIN reasons r ON r.page_id = pages.page_id AND r.url = pages.url
        LEFT JOIN verdict v ON v.id = r.page_id LEFT JOIN n ON n.url = pages.url AND v.keep)
    """


def bytes_pages(p: HarvestParams = HarvestParams()) -> str:
    """What comes out of the bytes is what the text gives, but for the broken ones."""
    return f"""
    SELECT page_id, r AS gate_reason, CASE WHEN r = 'pass' THEN text END AS text FROM (
        SELECT page_id, text, CASE WHEN html IS NULL THEN 'fetch_failed'
            WHEN ('0x' || substr(md5(page_id::VARCHAR), 1, 2))::INT % 6 = 5 THEN 'undecodable'
            WHEN html = '' AND ('0x' || substr(md5(page_id::VARCHAR), 1, 2))::INT % 6 = 0 THEN 'fetch_failed'
            ELSE {sql_gate_reason('text', p)} END AS r
        FROM (SELECT page_id, html, {sql_main_text('html')} AS text FROM pages))
    """


def group_split(p: HarvestParams = DOC_P, seed: int = 42) -> str:
    return f"""WITH {_harvest_ctes(p)},
    g AS (
        SELECT doc_id, row_number() OVER (ORDER BY md5('{seed}' || '#' || doc_id::VARCHAR), doc_id) AS r,
               count(*) OVER () AS n
        FROM (SELECT DISTINCT doc_id FROM samples))
    SELECT sample_id, doc_id, CASE WHEN r <= (n + 9) // 10 THEN 'test' ELSE 'train' END AS split
    FROM samples JOIN g USING (doc_id)"""


def card_stats(p: HarvestParams = DOC_P) -> str:
    return f"""WITH {_split_ctes(p)},
    g AS (SELECT split, source, count(*) AS n FROM split GROUP BY split, source),
    tot AS (SELECT coalesce(sum(n), 0) AS t FROM g)
    SELECT 'samples' AS stat, 'all' AS key, CAST((SELECT t FROM tot) AS VARCHAR) AS value
    UNION ALL
    SELECT 'size_category', 'all',
           CASE WHEN t < 1000 THEN 'n<1K' WHEN t < 10000 THEN '1K<n<10K'
                WHEN t < 100000 THEN '10K<n<100K' WHEN t < 1000000 THEN '100K<n<1M'
                ELSE 'n>1M' END FROM tot
    UNION ALL
    SELECT 'split_count', split, CAST(sum(n) AS VARCHAR) FROM g GROUP BY split
    UNION ALL
    SELECT 'split_share', split, printf('%.4f', sum(n) / greatest((SELECT t FROM tot), 1))
    FROM g GROUP BY split
    UNION ALL
    SELECT 'topic_count', source, CAST(sum(n) AS VARCHAR) FROM g GROUP BY source
    """
