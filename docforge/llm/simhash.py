"""SimHash near-deduplication over vantage-point trees.

1. Fingerprints: one pass over the texts.  A-Z are lower-cased, words are runs
   of other bytes than ``[\\x20\\x09-\\x0D]``, the shingles of ``words`` words are
   hashed by XXH64 (seed 42), and a bit is set where over half of the hashes
   have it.  Equal fingerprints are one point from here on.
2. Vantage-point tree: inner nodes hold a vantage fingerprint and a radius, the
   median Hamming distance to it; the near side is within the radius.  The tree
   is fitted on a bounded sample (``sample``) and steers only where points go:
   every point is sent to its leaf, and also visits each leaf that the triangle
   bound can't rule out for a partner within ``bits``.  Of two partners on
   different sides of a node the far one visits the near side, so one of each
   pair meets the other at its leaf.
3. A leaf (shard) compares its home points with all points that came, exactly.
   Inside, further vantage points and the triangle bound narrow it once more.
   Large leaves are split in tiles of bounded size, and a tile returns no pairs
   but each point's smallest linked point in the tile, a star per component.
4. Stars are contracted to global components (``components.contract``).

Null texts count as empty; a text without words has fingerprint zero, which
links like any other.  Ids may repeat or be null: ``component_id`` is the
smallest non-null id of the component (null only if it has none).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, keep_rows, row_key, written
from .components import contract

SEED = 42
WORDS, BITS = 4, 4
#: leaves and points in a leaf both grow as the root of all points (leaves:
#: sqrt(points / GRAIN)), which balances visiting copies against comparisons;
#: home and visiting points in a tile at most
GRAIN, HOME_TILE, VISIT_TILE = 512, 65_536, 524_288
#: fingerprints that the tree is fitted on at most, and its depth at most
SAMPLE, DEPTH = 20_000, 14


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[-n:] if len(found) >= words else ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in
                          zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = np.unpackbits(hashes[at:at + 65536].astype(">u8").view(np.uint8))
        counts += part.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = WORDS) -> DataFrame:
    """Written narrow rows (_row, _id, _row_key, fp); fp as a signed long."""
    rows = docs.select(F.col(id_col).alias("_id"), row_key(text_col).alias("_row_key"),
                       F.col(text_col).cast("string").alias("_text"))
    schema = rows.select("_id", "_row_key", F.lit(0).cast("bigint").alias("fp")).schema

    def add(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["_id", "_row_key", "fp"])

    return written(rows.mapInArrow(add, schema)
                   .withColumn("_row", F.monotonically_increasing_id()), "fingerprints")


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def grow(points: np.ndarray, depth: int, rng) -> list:
    """Nodes (vantage, radius) of a complete tree in heap order: children of
    node i are 2i+1 (near) and 2i+2 (far)."""
    nodes: list = [None] * ((1 << depth) - 1)
    parts = {0: points}
    for i in range(len(nodes)):
        own = parts.pop(i)
        tried = rng.choice(own, min(8, len(own)), replace=False) if len(own) else np.zeros(1, np.uint64)
        dist = [distance(own, v) for v in tried]
        best = max(range(len(tried)), key=lambda k: dist[k].std() if len(own) else 0)
        radius = int(np.median(dist[best])) if len(own) else 32
        near = dist[best] <= radius
        nodes[i] = (np.uint64(tried[best]), radius)
        if 2 * i + 2 < len(nodes):
            parts[2 * i + 1], parts[2 * i + 2] = own[near], own[~near]
    return nodes


def route(nodes: list, points: np.ndarray, bits: int):
    """Yields (leaf, positions in points, home?) for all leaves that the points
    live in or visit."""
    def go(i, at, home):
        if not len(at):
            return
        if i >= len(nodes):
            yield i - len(nodes), at, home
            return
        vantage, radius = nodes[i]
        d = distance(points[at], vantage).astype(np.int64)
        if home:
            yield from go(2 * i + 1, at[d <= radius], True)
            yield from go(2 * i + 2, at[d > radius], True)
            yield from go(2 * i + 1, at[(d > radius) & (d <= radius + bits)], False)
        else:
            yield from go(2 * i + 1, at[d <= radius + bits], False)
            yield from go(2 * i + 2, at[d > radius - bits], False)
    yield from go(0, np.arange(len(points)), True)


def close_pairs(home: np.ndarray, visit: np.ndarray, bits: int):
    """Yields (home positions, visit positions) of pairs within ``bits`` bits:
    vantage points split both sides again while the triangle bound rules out
    enough, then what is left is compared in blocks."""
    rng = np.random.default_rng(len(home))
    todo = [(np.arange(len(home)), np.arange(len(visit)))]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) > 1 << 22:
            vantage = home[rng.choice(a)]
            da = distance(home[a], vantage).astype(np.int64)
            db = distance(visit[b], vantage).astype(np.int64)
            radius = int(np.median(da))
            parts = [(a[da <= radius], b[db <= radius]),
                     (a[da > radius], b[db > radius]),
                     (a[(da <= radius) & (da > radius - bits)],
                      b[(db > radius) & (db <= radius + bits)]),
                     (a[(da > radius) & (da <= radius + bits)],
                      b[(db <= radius) & (db > radius - bits)])]
            if sum(len(x) * len(y) for x, y in parts) < 0.9 * len(a) * len(b):
                todo += parts
                continue
        step = max(1, (1 << 21) // len(b))
        for s in range(0, len(a), step):
            own, other = np.nonzero(distance(home[a[s:s + step]][:, None], visit[b][None]) <= bits)
            yield a[s:s + step][own], b[other]


def tile_stars(home: np.ndarray, visit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, star) of every point of the tile that is linked in it.  home and
    visit are distinct within themselves but may share points."""
    points = np.unique(np.concatenate((home, visit)))
    parent = np.arange(len(points))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at_home, at_visit = np.searchsorted(points, home), np.searchsorted(points, visit)
    for own, other in close_pairs(home, visit, bits):
        a, b = at_home[own], at_visit[other]
        # what one star holds already needs no second look
        new = parent[a] != parent[b]
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(points))], np.int64)
    linked = np.bincount(root, minlength=len(points))[root] > 1
    return points[linked], points[root[linked]]


def link_fingerprints(points: DataFrame, bits: int = BITS) -> DataFrame:
    """(node, root) of all distinct fingerprints ``points`` (fp) that link with
    another one within ``bits`` bits."""
    n = points.count()
    depth = min(DEPTH, int(np.ceil(np.log2(max(1, n / GRAIN)) / 2)))
    sample = bounded_sample(points, ["fp"], SAMPLE, n).toPandas()["fp"]
    nodes = grow(sample.to_numpy(np.int64).view(np.uint64), depth, np.random.default_rng(7))

    def send(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            for leaf, at, home in route(nodes, fp.view(np.uint64), bits):
                yield pd.DataFrame({"leaf": np.int32(leaf), "fp": fp[at], "home": home})

    sent = written(points.mapInPandas(send, "leaf int, fp long, home boolean"), "vp-shards")
    # at most 2**DEPTH rows of a few bytes: a proven bound for the broadcast
    sizes = sent.groupBy("leaf").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / HOME_TILE).cast("int").alias("rows"),
        F.ceil(F.count(F.lit(1)) / VISIT_TILE).cast("int").alias("cols"))
    sent = sent.join(F.broadcast(sizes), "leaf").where("rows > 0")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own = lambda k: F.pmod(F.xxhash64("fp"), F.col(k)).cast("int")
    tiles = sent.where("home").select(
        "leaf", own("rows").alias("i"), every("cols").alias("j"), "fp", "home").union(
        sent.select("leaf", every("rows").alias("i"), own("cols").alias("j"), "fp",
                    F.lit(False)))

    def stars(key, pdf):
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        home = pdf["home"].to_numpy(bool)
        node, star = tile_stars(fp[home], fp[~home], bits)
        return pd.DataFrame({"node": node.view(np.int64), "star": star.view(np.int64)})

    return contract(tiles.groupBy("leaf", "i", "j").applyInPandas(stars, "node long, star long"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Per row: id, fingerprint, component_id, kept (one row of each component), _row_key."""
    rows = fingerprints(docs, id_col, text_col, words)
    first = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"),
                     F.col("_row").alias("row"))
    points = written(rows.groupBy("fp").agg(F.min(first).alias("keep")), "points")
    roots = written(link_fingerprints(points.select("fp"), bits), "fingerprint-roots")
    linked = points.join(roots, points.fp == roots.node, "left").select(
        "fp", "keep", F.coalesce("root", "fp").alias("root"))
    linked = written(linked, "linked-points")
    lowest = written(linked.groupBy("root").agg(F.min("keep").alias("keep")), "component-first")
    point = written(linked.select("fp", "root").join(lowest, "root").select("fp", "keep"),
                    "point-component")
    return rows.join(point, "fp").select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("keep.id").alias("component_id"),
        (F.col("_row") == F.col("keep.row")).alias("kept"), "_row_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, columns unchanged."""
    kept = simhash_dedup(docs, id_col, text_col).where("kept").select(id_col, "_row_key")
    return keep_rows(docs, kept, id_col, text_col)


def op2_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_dedup(docs).drop("_row_key")
