"""Embedding near-deduplication by a subspace pigeonhole join.

Vectors link when their labels are equal and their cosine is at least
``threshold``.  For unit vectors that is a squared distance of at most
2 - 2 * threshold, the budget.

1. Equal vectors of a label collapse to one point with its number of copies.
2. Points are scaled to unit length, turned by a fixed random rotation and cut
   into ``blocks`` blocks of coordinates.  If two points are within the budget,
   they are within some block's share of it, proportional to its dimensions.
3. Each block is range-joined by itself.  Some of its leading axes are cut into cells
   at least as wide as the block's radius.  A point lives in its home cell and visits
   those neighbours that its ball reaches and that come later in cell order, so two
   points within the radius meet once per block, one of them at home.  How many axes
   and how wide follows from the number of points: whatever takes the fewest copies, visits
   and tiles of cells with more than ``CELL`` points together.
4. A cell's points are joined in its task by halving: a side is split at the median
   of its widest axis, and points of the other side farther than the radius from its
   box go (all axes of the block count).  What is left is checked by the block
   distance; pairs that an earlier block finds are left to that block, the rest is
   verified by the cosine in double precision.  Cells with more than ``TILE`` home
   points or visitors are dealt out in tiles of that size.  A task returns for every
   point its links weighted by copies, and one star per local component; no pairs.
5. Link counts are summed, stars contracted to global components.

Vectors that are null, zero, or hold null or non-finite components link with
nothing, as do vectors with a null label or of different lengths.  Ids may be
null or repeat; the smallest non-null id names a component, and of rows that tie
on it the first written row is the kept one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import contract

THRESHOLD, BLOCKS = 0.98, 8
#: points of a cell aimed at, and of a tile's side at most, for vectors of up to
#: ``NUMBERS`` numbers; of longer ones as many as take the same room
CELL, TILE, NUMBERS = 16384, 32768, 64
#: widths of cells that are considered, in radii (1 at least: only neighbours are visited)
WIDTHS = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0)
#: pairs that are checked at once, without halving
LEAF = 1 << 14
#: relative room for rounding before the exact check
SLACK = 1e-4


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """The fixed random orthogonal matrix for vectors of ``dim`` components."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> np.ndarray:
    return np.unique(np.linspace(0, dim, min(blocks, dim) + 1).astype(int))


def radius(edges: np.ndarray, k: int, threshold: float) -> float:
    """Radius of block k: the root of its share of the squared-distance budget."""
    share = (edges[k + 1] - edges[k]) / edges[-1]
    return float(np.sqrt(max(0.0, 2 - 2 * threshold) * share) * (1 + SLACK) + 1e-9)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without the BLAS library (its threads can hang in forked workers)."""
    return np.einsum("ik,jk->ij", a, b)


def usable_points(vectors: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """Rows that can link at all: (_row, _id, label, vec) with vec as doubles."""
    v = F.col("vec")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.where(v.isNotNull() & F.col("label").isNotNull() & F.forall(v, number)
                         & F.exists(v, lambda x: x != 0))


def cell_plan(dim: int, size: int, reach: float, n: int) -> tuple[int, float]:
    """(axes, width) of the cells of a block of ``size`` axes for ``n`` points of a
    label, by the figures of random unit vectors: a ball of radius r visits, in all
    directions, sum over j of C(axes, j) * V_j * (r / width)^j cells, V_j being the
    volume of the j-ball, and 2 * sqrt(pi) / sqrt(dim) / width cells an axis are in use."""
    best = None
    for axes in range(size + 1):
        for f in WIDTHS if axes else (1.0,):
            meets = sum(math.comb(axes, j) * math.pi ** (j / 2) / math.gamma(j / 2 + 1) / f ** j
                        for j in range(axes + 1))
            cells = max(1.0, 2 * math.sqrt(math.pi / dim) / (f * reach)) ** axes
            copies = (1 + meets) / 2
            aim = max(1, min(CELL, CELL * NUMBERS // dim))
            total = copies * max(1.0, n * copies / cells / aim)
            if best is None or total < best[0]:
                best = total, axes, f * reach
    return best[1:]


def meetings(lead: np.ndarray, width: float, reach: float):
    """Cells of points by their leading coordinates: yields (points, cells, at home?).
    A neighbour is visited if the ball reaches it and it comes later in cell order."""
    home = np.floor(lead / width).astype(np.int64)
    n = len(lead)
    at, cell = np.arange(n), home
    used, later = np.zeros(n), np.zeros(n, bool)        # squared way; a step up came first
    for axis in range(lead.shape[1]):
        low = lead[at, axis] - home[at, axis] * width
        parts = []
        for step, way in ((0, np.zeros(len(at))), (1, width - low), (-1, low)):
            total = used + np.maximum(way, 0) ** 2
            go = total <= reach ** 2
            if step < 0:
                go &= later
            moved = cell[go].copy()
            moved[:, axis] += step
            parts.append((at[go], moved, total[go], later[go] | (step > 0)))
        at, cell, used, later = (np.concatenate(x) for x in zip(*parts))
    yield np.arange(n), home, True
    yield at[later], cell[later], False


def near_pairs(x: np.ndarray, rows: np.ndarray, cols: np.ndarray | None, reach: float):
    """Candidate pairs (row, col) of points within ``reach``, in batches; with cols
    None pairs of two rows, each once.  Returns the generator's number of tests."""
    tests = 0
    todo = [(rows, cols)]
    room = reach * reach + 1e-9
    while todo:
        rows, cols = todo.pop()
        own = cols is None
        if not len(rows) or not own and not len(cols):
            continue
        if not own:
            box = x[rows]
            low, high = box.min(0), box.max(0)
            other = x[cols]
            off = np.maximum(np.maximum(low - other, other - high), 0)
            tests += len(cols)
            cols = cols[(off ** 2).sum(1) <= room]
            if not len(cols):
                continue
        right = rows if own else cols
        if len(rows) * len(right) <= LEAF:
            tests += len(rows) * len(right) // (2 if own else 1)
            u, w = x[rows], x[right]
            d = (u ** 2).sum(1)[:, None] + (w ** 2).sum(1)[None] - 2 * _product(u, w)
            a, b = np.nonzero(d <= room)
            if own:
                a, b = a[a < b], b[a < b]
            if len(a):
                yield rows[a], right[b]
            continue
        if not own and len(cols) > len(rows):
            rows, cols = cols, rows
        side = x[rows]
        axis = int(np.argmax(side.max(0) - side.min(0)))
        order = np.argpartition(side[:, axis], len(rows) // 2)
        one, two = rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]
        todo += [(one, None), (two, None), (one, two)] if own else [(one, cols), (two, cols)]
    return tests


def _packed(raw: np.ndarray) -> list[bytes]:
    """Rows as bytes: single precision where that is exact, else double."""
    with np.errstate(over="ignore"):
        narrow = raw.astype(np.float32)
    exact = (narrow == raw).all(1)
    return [narrow[k].tobytes() if exact[k] else raw[k].tobytes() for k in range(len(raw))]


def _unpacked(vectors, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64)
                     for v in vectors], float).reshape(-1, dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(1, keepdims=True)       # no overflow in the norm
    return raw / np.sqrt((raw ** 2).sum(1, keepdims=True))


def tile_links(vectors: np.ndarray, copies: np.ndarray, rows, cols, own: bool, k: int, turn,
               edges, threshold: float):
    """Links of a tile: pairs of ``rows`` (if own) and of rows with ``cols``, found by
    block k first.  Returns links and a root per point, and the number of tests."""
    unit = _unit(vectors)
    x = _product(unit, turn)
    n = len(x)
    links, parent, tests = np.zeros(n, np.int64), np.arange(n), 0

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def within(e, p, q):
        d = x[p, edges[e]:edges[e + 1]] - x[q, edges[e]:edges[e + 1]]
        return (d ** 2).sum(1) <= radius(edges, e, threshold) ** 2

    block = np.ascontiguousarray(x[:, edges[k]:edges[k + 1]])
    for side in ([None, cols] if own else [cols]):
        found = near_pairs(block, rows, side, radius(edges, k, threshold))
        while True:
            try:
                p, q = next(found)
            except StopIteration as end:
                tests += end.value or 0
                break
            keep = within(k, p, q)
            p, q = p[keep], q[keep]
            keep = (unit[p] * unit[q]).sum(1) >= threshold
            p, q = p[keep], q[keep]
            for e in range(k):                          # an earlier block has found it
                keep = ~within(e, p, q)
                p, q = p[keep], q[keep]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            new = parent[p] != parent[q]
            for u, w in zip(p[new].tolist(), q[new].tolist()):
                u, w = find(u), find(w)
                if u != w:
                    parent[max(u, w)] = min(u, w)
    return links, np.array([find(a) for a in range(n)], np.int64), tests


def link_points(points: DataFrame, threshold: float = THRESHOLD,
                blocks: int = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """points: (point long, label, vec array<double>, copies long).
    Returns (point, links) and stars (node, star), both written."""
    # a few numbers for each length of vectors: the largest label's points
    sizes = (points.groupBy(F.size("vec").alias("dim"), "label").count()
             .groupBy("dim").agg(F.max("count").alias("n")).collect())
    plans = {}
    for r in sizes:
        edges = block_edges(r["dim"], blocks)
        plans[r["dim"]] = (rotation(r["dim"]), edges, [
            cell_plan(r["dim"], int(edges[k + 1] - edges[k]), radius(edges, k, threshold), r["n"])
            for k in range(len(edges) - 1)])

    def deal(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vec"].map(len)):
                turn, edges, cells = plans[dim]
                raw = np.array(part["vec"].tolist(), float)
                x = _product(_unit(raw), turn)
                packed = np.array(_packed(raw), object)
                label, point, copies = (part[c].to_numpy() for c in ("label", "point", "copies"))
                for k, (axes, width) in enumerate(cells):
                    lead = x[:, edges[k]:edges[k] + axes]
                    for at, cell, home in meetings(lead, width, radius(edges, k, threshold) + 1e-9):
                        if len(at):
                            yield pd.DataFrame({
                                "dim": np.int32(dim), "label": label[at], "block": np.int32(k),
                                "cell": list(cell), "home": home, "point": point[at],
                                "copies": copies[at], "vec": packed[at]})

    label_type = points.schema["label"].dataType.simpleString()
    dealt = written(points.mapInPandas(
        deal, f"dim int, label {label_type}, block int, cell array<long>, home boolean, "
              "point long, copies long, vec binary"), "cells")
    key = ["dim", "label", "block", "cell"]
    tile = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE * NUMBERS) / F.col("dim"))))
    parts = lambda side: F.ceil(F.col(side) / tile).cast("int").alias(side)
    counts = written(dealt.groupBy(*key).agg(
        F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.when(~F.col("home"), 1)).alias("visits"))
        .select(*key, parts("homes"), parts("visits")).where("homes > 1 or visits > 1"), "crowded-cells")
    # homes are parts 0 to homes - 1, visitors the next ones; tile (i, j), i <= j, has part i
    # at home, so a home part meets every part, a visiting part every home part
    hash_ = F.xxhash64("point")
    parted = dealt.join(counts, key, "left")
    own = F.when(F.col("homes").isNull(), F.lit(0)).when(F.col("home"), F.pmod(hash_, F.col("homes"))).otherwise(
        F.col("homes") + F.pmod(hash_, F.col("visits"))).cast("int")
    others = F.when(F.col("homes").isNull(), 1).when(F.col("home"), F.col("homes") + F.col("visits")).otherwise(
        F.col("homes"))
    tiles = (parted.withColumn("own", own).withColumn("others", others).where("others > 0")
             .select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("with"))
             .withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")})
             .drop("with", "others", "homes", "visits"))

    def check(key, pdf):
        dim, _, k, _, i, j = key
        turn, edges, _ = plans[dim]
        first = pdf["own"].to_numpy() == i
        home = pdf["home"].to_numpy(bool)
        rows = np.flatnonzero(first & home)
        cols = np.flatnonzero(~home if i == j else ~first)
        copies, point = pdf["copies"].to_numpy(np.int64), pdf["point"].to_numpy(np.int64)
        if not len(rows) or len(rows) == 1 and not len(cols):
            links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        else:
            links, root, _ = tile_links(_unpacked(pdf["vec"], dim), copies, rows, cols, i == j, k,
                                        turn, edges, threshold)
        hit = links > 0
        lowest = np.full(len(pdf), np.iinfo(np.int64).max)
        np.minimum.at(lowest, root, point)
        return pd.DataFrame({"point": point[hit], "links": links[hit], "star": lowest[root][hit]})

    found = written(tiles.groupBy(*key, "i", "j").applyInPandas(
        check, "point long, links long, star long"), "links")
    return (found.groupBy("point").agg(F.sum("links").alias("links")),
            found.select(F.col("point").alias("node"), "star").distinct())


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD,
                    blocks: int = BLOCKS) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    rows = written(vectors.select(
        F.col(id_col).alias("_id"), F.col(label_col).alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"))
        .withColumn("_row", F.monotonically_increasing_id()), "vectors")
    first = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"),
                     F.col("_row").alias("row"))
    points = written(usable_points(rows, vec_col, label_col).groupBy("label", "vec").agg(
        F.count(F.lit(1)).alias("copies"), F.min("_row").alias("point"), F.min(first).alias("keep")),
        "vector-points")
    links, stars = link_points(points.select("point", "label", "vec", "copies"), threshold, blocks)
    roots = contract(stars)
    named = written(points.select("point", "copies", "keep", "label", "vec")
                    .join(links, "point", "left").join(
                        roots.withColumnRenamed("node", "point"), "point", "left")
                    .select("label", "vec", "keep",
                            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                            F.coalesce("root", "point").alias("root")), "linked-vectors")
    lowest = named.groupBy("root").agg(F.min("keep").alias("keep"))
    point = written(named.drop("keep").join(written(lowest, "component-first"), "root").drop("root"),
                    "vector-components")
    out = rows.join(point, ["label", "vec"], "left")
    alone = F.col("keep").isNull()
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(alone, F.col("_id")).otherwise(F.col("keep.id")).alias("component_id"),
        (alone | (F.col("_row") == F.col("keep.row"))).alias("kept"))


def op8_subspace_join(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
    AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN e IF x <> 0]) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END),
reach AS (SELECT vec_id AS node, vec_id AS other FROM v
    UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE a = v.vec_id) AS n_links,
    min(other) AS component_id, min(other) = v.vec_id AS kept
FROM v JOIN reach ON node = v.vec_id GROUP BY v.vec_id
"""
