"""BPE, WARC, packing, token counts, embeddings and the pipeline against brute force."""
import base64
import hashlib
import io
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
import zstandard

import corpus_pipeline
from docforge.llm import byte_bpe, embedding_dedup, packing, quality, queries, simhash, token_counts, toxicity, warc
from docforge.session import scratch_path
from tests.llm.test_dedup import norm, smallest_groups

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


def pairs_of(df, *cols):
    return sorted(tuple(map(str, (r[c] for c in cols))) for r in df.collect())


# ---------------------------------------------------------------- BPE


@pytest.mark.parametrize("block,piece", [(1, 10**9), (200, 2), (10**9, 7), (10**9, 150_000)])
def test_encode_equals_the_library(odd_docs, block, piece, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE", piece)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    docs = odd_docs.repartition(3).union(odd_docs.sparkSession.createDataFrame(
        [(50, "<|endoftext|> x" + chr(0x1c) + "\x85    don't DON'T  ", "en", "s", 1, "c", 0.5, 1, "k")],
        odd_docs.schema))
    got = byte_bpe.encode(docs, RANKS, block=block, stable=block > 1).collect()
    want = [(r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode())
            for r in docs.collect()]
    key = lambda x: (str(x[0]), x[2], x[1])
    assert sorted(((r.doc_id, r.token_ids, bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)


def test_equal_words_meet_in_one_bucket(some_docs):
    """So that each distinct word is encoded once, and sent once per block."""
    rows = byte_bpe.explode_words(some_docs, "doc_id", "text", public_tokenizers.PATTERN, 50_000)
    bucket_of, sent = {}, set()
    for r in rows.where("words IS NOT NULL").collect():
        text, at = zstandard.decompress(bytes(r.words)).decode(), 0
        for n in byte_bpe.unsqueeze(bytes(r.lengths)).tolist():
            word = text[at:at + n]
            at += n
            assert bucket_of.setdefault(word, r.bucket) == r.bucket and (word, r.block) not in sent
            sent.add((word, r.block))
    assert len({b for _, b in sent}) > 3 and set(bucket_of) == {
        w for r in some_docs.collect() for w in regex.findall(public_tokenizers.PATTERN, r.text)}


def test_decode_is_a_join(spark):
    rows = spark.createDataFrame([(1, [0, 5, 5, 50_000]), (1, []), (None, None)], "k long, token_ids array<int>")
    table = {r: b for b, r in byte_bpe.read_ranks(RANKS).items()}
    got = sorted(((r.k, None if r.decoded is None else bytes(r.decoded)) for r in
                  byte_bpe.decode(rows, RANKS).collect()), key=str)
    assert got == sorted([(1, table[0] + table[5] + table[5] + table[50_000]), (1, b""), (None, None)], key=str)


def test_encode_empty_table(no_docs):
    assert byte_bpe.encode(no_docs, RANKS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_squeeze(n):
    x = np.random.default_rng(n).integers(0, 1 << 32, n).astype(np.uint32)
    assert (byte_bpe.unsqueeze(byte_bpe.squeeze(x)) == x).all()


# ---------------------------------------------------------------- WARC


def odd_pages(spark):
    big, url = "<p>" + "payload é " * 200, "http://x.example/a b\r\nEvil: 1"
    rows = [(1, url, big), (5, None, big), (5, "u", big), (3, "u", big), (None, "u", big),
            (7, "u", "small"), (8, "u", "small"), (9, "u", None), (None, "u", ""), (10, "u", "x" * 1000),
            (11, "u", "x" * 1000), (12, "u", "y" * 999), (13, "u", "y" * 999), (14, "u", "z" * 2_000_000),
            (None, "u", "n" * 2000), (None, "v", "n" * 2000), (15, "u", "\x00WARC/1.1\r\n\r\n" * 100)]
    return spark.createDataFrame([(*r, 1, "q") for r in rows],
                                 "page_id long, url string, html string, _id long, frame string")


def expected_records(rows):
    top = defaultdict(list)
    for r in rows:
        top[r.html or ""].append(r.page_id)
    out = []
    for r in rows:
        h = r.html or ""
        ids = [i for i in top[h] if i is not None]
        best = max(ids) if ids else None
        revisit = len(h.encode()) >= 1000 and r.page_id != best
        out.append((r.page_id, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(),
                    "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_archives_round_trip(spark, broadcast, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    pages = odd_pages(spark).repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in got), key=str) == expected_records(pages.collect())
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(r.html.encode()).hexdigest() == r.payload_digest
        assert "\n" not in (r.url or "")


def test_archive_format(spark):
    """A plain Zstandard decoder reads the files: dictionary frame, then records."""
    path = scratch_path(spark, "warc-format")
    warc.write_archives(spark.read.parquet(f"{SMALL}/pages.parquet"), path)
    files = spark.read.format("binaryFile").load(path).collect()
    seen = 0
    for f in files:
        data = bytes(f.content)
        size = int.from_bytes(data[4:8], "little")
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and size > 0
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
        plain = decoder.stream_reader(io.BytesIO(data), read_across_frames=True).read()
        for head, block in warc.parse(io.BytesIO(plain)):
            seen += 1
            digest = base64.b32encode(hashlib.sha1(block.partition(b"\r\n\r\n")[2]).digest()).decode()
            assert head["warc-payload-digest"] == f"sha1:{digest}" or head["warc-type"] == "revisit"
        assert data.count(b"\x28\xb5\x2f\xfd") >= plain.count(b"WARC/1.1\r\n")   # a frame per record
    assert seen == spark.read.parquet(f"{SMALL}/pages.parquet").count()


@pytest.mark.parametrize("n,size", [(3, 400_000), (40, 40_000)])
def test_long_records_train_the_dictionary(spark, n, size):
    r = random.Random(n)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(500)]
    text = lambda: " ".join(r.choices(words, k=size // 5))
    pages = spark.createDataFrame([(k, "u", text()) for k in range(n)], "page_id long, url string, html string")
    assert pages.where(f"length(html) <= {warc.SAMPLE_BYTES}").isEmpty()
    assert len(warc.train(pages, "page_id", "html")) > 1000


def test_few_short_records_make_a_full_sample(spark, monkeypatch):
    """The sample is thinned by the number of its own rows."""
    seen = []
    monkeypatch.setattr(warc, "SAMPLE", 20)
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda size, parts, **_: (
        seen.extend(parts), zstandard.ZstdCompressionDict(b"x" * 100))[1])
    pages = spark.range(400).selectExpr(
        "id AS page_id", f"repeat(cast(id AS string), IF(id % 100 = 0, 1000, {2 * warc.SAMPLE_BYTES})) AS html")
    assert warc.train(pages, "page_id", "html") and len(seen) == 20


def test_archives_of_no_pages(spark):
    path = scratch_path(spark, "warc-none")
    warc.write_archives(odd_pages(spark).where("false"), path)
    assert warc.read_archives(spark, path).count() == 0


# ---------------------------------------------------------------- packing


def brute_padding(hist, buckets):
    best = {0: 0}
    out = None
    for _ in range(buckets):
        new = {}
        for j in range(1, len(hist) + 1):
            costs = [c + sum(n * (hist[j - 1][0] - x) for x, n in hist[i:j])
                     for i, c in best.items() if i < j]
            if costs:
                new[j] = min(costs)
        best = new
        if len(hist) in best:
            out = min(best[len(hist)], out if out is not None else best[len(hist)])
    return out


def test_optimal_bounds():
    for seed in range(150):
        r = random.Random(seed)
        hist = [(x, r.randint(1, 9)) for x in sorted(r.sample(range(200), r.randint(1, 12)))]
        k = r.randint(1, 5)
        bounds = packing.optimal_bounds(hist, k)
        assert len(bounds) <= k and bounds[-1] == hist[-1][0]
        assert sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist) == brute_padding(hist, k)
    assert packing.optimal_bounds([], 3) == []


@pytest.mark.parametrize("table", ["odd", "some"])
def test_packing(odd_docs, some_docs, table):
    docs = odd_docs if table == "odd" else some_docs
    got = packing.pack_documents(docs, buckets=4, budget=2000, quantum=4).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted(
        (str(r.doc_id), len((r.text or "").encode().split())) for r in docs.collect())
    batches = defaultdict(list)
    for r in got:
        assert r.padded_length >= r.n_tokens and r.padded_length % 4 == 0
        batches[r.bucket, r.batch].append(r)
    hist = defaultdict(int)
    for r in got:
        hist[-(-r.n_tokens // 4) * 4] += 1
    assert sum(r.padded_length - -(-r.n_tokens // 4) * 4 for r in got) == brute_padding(sorted(hist.items()), 4)
    last = {b: max(k for c, k in batches if c == b) for b, _ in batches}
    for (bucket, batch), rows in batches.items():
        capacity = max(1, 2000 // max(1, rows[0].padded_length))
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == capacity or batch == last[bucket] and len(rows) < capacity
        assert len({r.padded_length for r in rows}) == 1


def test_registered_query_pads_to_any_length(spark, tmp_path):
    """Bounds aren't restricted to multiples of 8."""
    rows = [(k, "w " * n) for k, n in enumerate([1, 2, 3, 5, 8, 9, 9, 9, 17])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_length_buckets"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.padded_length == r.n_tokens for r in got)


def test_least_padding_of_the_table(spark):
    got = queries.QUERIES["op6_length_buckets"](spark, SMALL).collect()
    hist = defaultdict(int)
    for r in got:
        hist[r.n_tokens] += 1
    assert sum(r.padded_length - r.n_tokens for r in got) == brute_padding(sorted(hist.items()), 16)


def test_packing_no_rows(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


# ---------------------------------------------------------------- token counts


@pytest.mark.parametrize("file", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_cache(spark, odd_docs, no_docs, file):
    path, cache = public_tokenizers.path(file), scratch_path(spark, "counts-test")
    if file.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    special = odd_docs.limit(1).selectExpr("0 AS doc_id", "'a <s> </s> <|endoftext|> b' AS text")
    docs = odd_docs.select("doc_id", "text").union(special)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), count(r.text or "")) for r in docs.collect())
    first = docs.limit(5)
    token_counts.token_counts(first, path, cache)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r.text or "" for r in first.collect()})
    got = token_counts.token_counts(docs, path, cache, limit=3).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)
    n = spark.read.parquet(cache).count()
    assert n == len({r.text or "" for r in docs.collect()})      # each content was encoded once
    token_counts.token_counts(docs, path, cache).count()
    assert spark.read.parquet(cache).count() == n
    assert token_counts.token_counts(no_docs, path, cache).count() == 0


# ---------------------------------------------------------------- embeddings


def brute_links(rows, threshold):
    ok, unit = [], []
    for k, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append(k)
            a = np.array(v, float)
            unit.append(a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            i, j = ok[a], ok[b]
            if rows[i][2] == rows[j][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    return links, [find(k) for k in range(len(rows))]


@pytest.mark.parametrize("tile,cell", [(4096, 2048), (7, 5)])
def test_embedding_links(spark, monkeypatch, tile, cell):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 5)):
            v = base * rng.uniform(0.1, 10) + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.2])
            rows.append((v.tolist(), int(k % 3)))
    hot = rng.normal(size=16)
    rows += [((hot + rng.normal(size=16) * 0.1).tolist(), 1) for _ in range(60)]      # a crowded cell
    rows += [(hot.tolist(), 1)] * 30 + [(hot.tolist(), 2), (hot.tolist(), None), (None, 1), ([0.0] * 16, 1),
                                        ([float("nan")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1),
                                        ([float("inf")] + [1.0] * 15, 1), ([], 1), (hot[:8].tolist(), 1),
                                        (hot[:8].tolist(), 1), ([3.0], 1), ([5.0], 1), ([-5.0], 1),
                                        ([1e300] * 16, 1), ([1e-300] * 16, 1), ([1.0] * 16, 1)]
    rows = [(100 + k, v, label) for k, (v, label) in enumerate(rows)]
    rng.shuffle(rows)
    rows = [(i, v, None if label is None else int(label)) for i, v, label in rows]
    df = spark.createDataFrame([(int(i), v, label, 0, "c") for i, v, label in rows],
                               "vec_id long, embedding array<double>, label int, point int, cell string")
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df.repartition(4)).collect()}
    links, root = brute_links(rows, 0.98)
    classes = defaultdict(list)
    for k, r in enumerate(root):
        classes[r].append(rows[k][0])
    assert len(got) == len(rows) and max(links) > 80
    for k, (i, _, _) in enumerate(rows):
        assert got[i].n_links == links[k]
        assert got[i].component_id == min(classes[root[k]]) and got[i].kept == (i == min(classes[root[k]]))
    assert embedding_dedup.embedding_dedup(df.where("false")).count() == 0


def candidates(x, rows, cols, reach):
    out, found = [], embedding_dedup.near_pairs(x, rows, cols, reach)
    while True:
        try:
            p, q = next(found)
        except StopIteration as end:
            return out, end.value or 0
        out += [tuple(sorted(pair)) for pair in zip(p.tolist(), q.tolist())]


@pytest.mark.parametrize("leaf", [1, 16, 1 << 14])
def test_halving_finds_every_near_pair_once(monkeypatch, leaf):
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(150, 3)), np.repeat(rng.normal(size=(2, 3)), 20, 0)])
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    close = lambda a, b: sorted((min(i, j), max(i, j)) for i in a for j in b
                                if distance[i, j] <= 0.5)
    every, some = np.arange(190), rng.permutation(190)
    got, _ = candidates(x, every, None, 0.5)
    assert sorted(got) == sorted((j, i) for i in range(190) for j in range(i) if distance[i, j] <= 0.5)
    got, _ = candidates(x, some[:90], some[90:], 0.5)
    assert sorted(got) == close(some[:90].tolist(), some[90:].tolist())


@pytest.mark.parametrize("axes,width", [(0, 1.0), (1, 0.5), (3, 0.5), (3, 0.9)])
def test_near_points_meet_in_one_cell(axes, width):
    """Of two points within the radius just one comes to the other's home, or they share it."""
    x = np.random.default_rng(9).normal(size=(300, 3))
    home, comes = {}, defaultdict(set)
    for at, cells, own in embedding_dedup.meetings(x[:, :axes], width, 0.5):
        for k, c in zip(at.tolist(), map(tuple, cells.tolist())):
            if own:
                home[k] = c
            else:
                assert k not in comes[c]
                comes[c].add(k)
    assert len(home) == 300
    for i in range(300):
        for j in range(i):
            if np.sqrt(((x[i] - x[j]) ** 2).sum()) <= 0.5:
                assert (home[i] == home[j]) + (i in comes[home[j]]) + (j in comes[home[i]]) == 1


def test_block_tests_fall_with_the_number_of_points():
    """Tests per pair of random unit vectors fall as n grows, in the task alone."""
    def tests_per_pair(n):
        x = np.random.default_rng(2).normal(size=(n, 64))
        x = (x / np.sqrt((x ** 2).sum(1, keepdims=True)))[:, :8].copy()
        edges = embedding_dedup.block_edges(64, 8)
        _, tests = candidates(x, np.arange(n), None, embedding_dedup.radius(edges, 0, 0.98))
        return 8 * tests / (n * (n - 1) / 2)
    few, many = tests_per_pair(4000), tests_per_pair(16000)
    assert many < few / 2 and many < 0.5


def test_embedding_null_and_repeated_ids(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(None, v, 1), (3, v, 1), (3, v, 1), (None, None, 1)],
                               "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.embedding_dedup(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == [
        ("3", 2, "3"), ("3", 2, "3"), ("None", 0, "None"), ("None", 2, "3")]
    assert sum(r.kept for r in got) == 2


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), "stage-test")
        assert docs.columns == columns
        counts.append(docs.count())
        assert docs.exceptAll(before).isEmpty()
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.count() == counts[-1]
    assert pairs_of(packed, "doc_id") == pairs_of(docs, "doc_id")
    whole = corpus_pipeline.run(spark, sf_dir)
    assert pairs_of(whole, *whole.columns) == pairs_of(packed, *packed.columns)


def test_pipeline_stages_keep_the_right_ids(spark):
    """Each stage against a plain computation on the rows it is given."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = lambda rows: sorted(r.doc_id for r in rows)
    stages = [stage for _, stage in corpus_pipeline.STAGES[:-1]]

    def run(stage):
        return corpus_pipeline.written(stage(spark, docs, sf_dir), "ids-test")

    for stage, module, good in ((stages[0], quality, lambda s: s >= 0.5), (stages[1], toxicity, lambda s: s < 0.3)):
        scored = module.add_scores(docs, module.fit(docs, labels)).collect()
        after = run(stage)
        assert ids(after.collect()) == ids(r for r in scored if good(r.score))
        docs = after
    least = {}
    for r in docs.collect():
        least[norm(r.text)] = min(least.get(norm(r.text), r.doc_id), r.doc_id)
    docs = run(stages[2])
    assert ids(docs.collect()) == sorted(least.values())
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    points = np.array([simhash.fingerprint(r.text) for r in rows], np.uint64)
    pairs = [(rows[i].doc_id, rows[j].doc_id) for i in range(len(rows))
             for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= simhash.BITS) if i != j]
    group = smallest_groups(pairs)
    assert any(i != g for i, g in group.items())
    assert ids(run(stages[3]).collect()) == [r.doc_id for r in rows if group.get(r.doc_id, r.doc_id) == r.doc_id]


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
