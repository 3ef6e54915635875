"""Packing: length buckets that minimise padding, and token-budget batches.

1. Lengths: tokens are the runs of non-white-space bytes of the whole text
   (null counts as empty), or a given column.  Each length counts by itself; a
   ``quantum`` above 1 rounds lengths up to its multiples first, and padding is
   the least among bounds of that kind.
2. The global histogram is one partially aggregated count per length; dynamic
   programming over it chooses at most ``buckets`` upper bounds with the least
   total padding.  The costs are lines in the length with falling slopes, so
   each of the rounds is one pass with a monotone hull: exact for any histogram.
3. Inside a bucket with bound b, a batch holds ``budget`` // b rows (one at
   least).  Rows get their position in the order (bucket, length, id hash, row)
   by range partitions, numbering inside each, and offsets of one row per
   (partition, bucket): no bucket is one task, and each batch but a bucket's
   last is full.

Every row is packed: empty texts have length 0, rows longer than the budget
make batches of their own.  Ids may be null or repeat.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

BUCKETS, BUDGET, QUANTUM = 16, 65_536, 1


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written narrow rows (_row, _id, n_tokens)."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    schema = rows.select("_id", F.lit(0).cast("bigint").alias("n_tokens")).schema

    def count(batches):
        for b in batches:
            n = [len(t.encode("utf-8", "surrogatepass").split()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())],
                                             ["_id", "n_tokens"])

    return written(rows.mapInArrow(count, schema)
                   .withColumn("_row", F.monotonically_increasing_id()), "token-lengths")


def optimal_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over (length, rows), lengths
    rising, that minimise the sum of rows * (bound - length)."""
    if not histogram:
        return []
    length = [x for x, _ in histogram]
    rows, tokens = [0], [0]
    for x, n in histogram:
        rows.append(rows[-1] + n)
        tokens.append(tokens[-1] + n * x)
    size = len(length)
    cost = [0] + [None] * size          # padding of the first j lengths, None: not yet reachable
    origin: list[list[int]] = []
    best, used = None, 0
    for k in range(min(buckets, size)):
        new, came = [None] * (size + 1), [0] * (size + 1)
        hull: deque = deque()           # lines (slope, height, start), slopes falling
        for j in range(1, size + 1):
            if cost[j - 1] is not None:
                line = (-rows[j - 1], cost[j - 1] + tokens[j - 1], j - 1)
                while len(hull) > 1 and _covered(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = length[j - 1]
            while len(hull) > 1 and hull[0][0] * x + hull[0][1] >= hull[1][0] * x + hull[1][1]:
                hull.popleft()
            if hull:
                new[j] = hull[0][0] * x + hull[0][1] + x * rows[j] - tokens[j]
                came[j] = hull[0][2]
        origin.append(came)
        cost = new
        if best is None or cost[size] < best:
            best, used = cost[size], k + 1
    bounds, j = [], size
    for came in reversed(origin[:used]):
        bounds.append(length[j - 1])
        j = came[j]
    return bounds[::-1]


def _covered(a, b, c) -> bool:
    """The middle line is nowhere below both others."""
    return ((c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])
            if a[0] != b[0] and a[0] != c[0] else b[1] >= c[1])


def padded(n: Column, quantum: int) -> Column:
    return (F.ceil(n / quantum) * quantum).cast("bigint")


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET,
         quantum: int = QUANTUM) -> DataFrame:
    """Adds bucket, padded_length, batch (number inside the bucket) and slot
    to rows (_row, _id, n_tokens)."""
    spark = lengths.sparkSession
    size = padded(F.col("n_tokens"), quantum)
    histogram = sorted((r[0], r[1]) for r in
                       lengths.groupBy(size.alias("size")).count().collect())
    bounds = optimal_bounds(histogram, buckets)
    # the bounds are at most `buckets` numbers, held in the expression itself
    bucket, bound = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for k, b in reversed(list(enumerate(bounds))):
        bucket = F.when(size <= b, F.lit(k)).otherwise(bucket)
        bound = F.when(size <= b, F.lit(b).cast("bigint")).otherwise(bound)
    order = ["bucket", "n_tokens", "_hash", "_row"]
    parts = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(
        lengths.select("*", bucket.alias("bucket"), bound.alias("padded_length"),
                       F.xxhash64("_id").alias("_hash"))
        .repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"),
                F.monotonically_increasing_id().alias("_at")), "length-order")
    # one row for each partition and bucket in it: at most parts + buckets rows
    counts = ranged.groupBy("bucket", "_part").agg(F.count(F.lit(1)).alias("_n"),
                                                   F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("bucket").orderBy("_part")) - F.col("_n")
    offsets = counts.select("bucket", "_part", (before - F.col("_first")).alias("_offset"))
    position = F.col("_at") + F.col("_offset")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded_length", F.lit(1))))
    return ranged.join(F.broadcast(offsets), ["bucket", "_part"]).select(
        "_row", "_id", "n_tokens", "bucket", "padded_length",
        F.floor(position / capacity).cast("bigint").alias("batch"),
        (position % capacity).cast("bigint").alias("slot"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   buckets: int = BUCKETS, budget: int = BUDGET,
                   quantum: int = QUANTUM) -> DataFrame:
    """Per row: id, n_tokens, bucket, padded_length, batch, slot."""
    packed = pack(token_lengths(docs, id_col, text_col), buckets, budget, quantum)
    return packed.withColumnRenamed("_id", id_col).drop("_row")


def op6_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
