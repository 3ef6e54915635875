"""Exact dedup, SimHash dedup and components against brute force."""
import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from docforge.llm import simhash
from docforge.llm.components import components, contract
from docforge.llm.exact_dedup import digest_rows, drop_copies, exact_dedup, tree_merge


def smallest_groups(pairs):
    """node -> smallest node reachable, over a list of pairs."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in sorted(near):
        todo = [start] if start not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("parts", [1, 40])
def test_exact_dedup_odd_rows(odd_docs, parts):
    rows = odd_docs.repartition(parts)
    got = exact_dedup(rows, fan_bits=1).collect()
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[hashlib.sha256(norm(r.text).encode()).hexdigest()].append(r.doc_id)
    assert len(got) == odd_docs.count()
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.keep_id == (min(known) if known else None)
        assert r.group_size == len(ids)
        assert not r.kept or r.doc_id == r.keep_id
    for sha in groups:      # exactly one row of each group stays, also of repeated rows
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1


def test_tree_merge_levels_agree(some_docs):
    rows = digest_rows(some_docs.repartition(30))
    a = {r.text_sha256: (r.group_size, r._keep.id) for r in tree_merge(rows, 1).collect()}
    b = {r.text_sha256: (r.group_size, r._keep.id) for r in tree_merge(rows, 6).collect()}
    assert a == b and len(a) == rows.select("text_sha256").distinct().count()


def test_drop_copies_keeps_columns(odd_docs, no_docs):
    kept = drop_copies(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(
        {norm(r.text) for r in odd_docs.collect()})
    assert drop_copies(no_docs).count() == 0 and exact_dedup(no_docs).count() == 0


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text, words=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    shingles = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b C d", "a b c d e f g a b c d",
                                  "É é Ä ß 日本 x", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def near_points(rng, n, flips):
    """Distinct fingerprints with clusters: chains of few flipped bits."""
    out = [int(x) for x in rng.integers(0, 1 << 63, n)]
    for x in out[: n // 3]:
        for _ in range(3):
            for b in rng.choice(64, rng.integers(1, flips + 1), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def brute_roots(points, bits):
    pairs = [(int(points[i]), int(points[j])) for i in range(len(points))
             for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= bits) if i != j]
    return smallest_groups(pairs)


def test_tree_routes_every_close_pair_to_one_leaf():
    rng = np.random.default_rng(3)
    points = near_points(rng, 600, 6)
    nodes = simhash.grow(points, 5, rng)
    home, comes = {}, defaultdict(set)
    for leaf, at, own in simhash.route(nodes, points, 4):
        for k in at.tolist():
            comes[leaf].add(k)
            if own:
                assert k not in home
                home[k] = leaf
    assert len(home) == len(points)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4).tolist():
            assert j in comes[home[i]] or i in comes[home[j]]


def test_link_fingerprints_matches_brute_force(spark, monkeypatch):
    # small tiles, so that leaves are split
    monkeypatch.setattr(simhash, "GRAIN", 4)
    monkeypatch.setattr(simhash, "HOME_TILE", 30)
    monkeypatch.setattr(simhash, "VISIT_TILE", 50)
    points = near_points(np.random.default_rng(5), 700, 5)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1
           for r in simhash.link_fingerprints(df).collect()}
    expected = brute_roots(points, 4)
    assert set(got) == set(expected)
    classes = lambda d: sorted(sorted(k for k in d if d[k] == r) for r in set(d.values()))
    assert classes(got) == classes(expected)


def test_close_pairs_in_a_dense_cluster():
    rng = np.random.default_rng(1)
    base = np.uint64(rng.integers(1 << 63))
    points = np.unique(np.array([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b))
                                 for a in range(64) for b in range(64)] * 2, np.uint64))
    node, star = simhash.tile_stars(points, points, 4)
    assert set(node.tolist()) == set(points.tolist()) and set(star.tolist()) == {int(points.min())}


def test_simhash_dedup_odd_rows(odd_docs, no_docs):
    got = simhash.simhash_dedup(odd_docs).collect()
    texts = odd_docs.collect()
    assert len(got) == len(texts)
    fps = sorted(f"{brute_fingerprint(r.text):016x}" for r in texts)
    assert sorted(r.fingerprint for r in got) == fps
    for r in got:
        ids = [x.doc_id for x in texts if x.doc_id is not None
               and f"{brute_fingerprint(x.text):016x}" == r.fingerprint]
        assert r.component_id == (min(ids) if ids else None)
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.schema == odd_docs.schema
    assert kept.count() == len({(r.component_id, r.fingerprint) for r in got})
    assert simhash.simhash_dedup(no_docs).count() == 0


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2)) if a != b]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == smallest_groups(pairs)
    stars = [(n, min(n, m)) for a, b in pairs for n, m in ((a, b), (b, a))]
    stars += [(m, m) for _, m in stars]
    got = {r.node: r.root for r in contract(spark.createDataFrame(stars, "node long, star long")).collect()}
    assert got == smallest_groups(pairs)
