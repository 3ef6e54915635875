"""Target-distribution importance resampling: array-scored weights, distributed quickselect.

1. Features of a text are its runs of up to ``runs`` consecutive words; A-Z is lowered
   first.  A feature belongs to a bucket by its CRC-32.  Bucket counts of all documents and
   of all target texts are partial aggregates; what comes to the driver is one number for
   each bucket, so its size is the parameter ``buckets``.
2. A bucket's gain is the scaled log ratio of its smoothed shares.  The gains are an array
   in the plan, and a document's weight is the floored mean of what its features pick
   from it: no join and no shuffle of features.
3. The score adds a Gumbel number made from the id, so the highest scores are a draw
   without replacement in proportion to exp(weight).
4. Of the N documents with at least ``min_words`` words the ``share`` with the highest
   scores are drawn.  Distributed quickselect finds the composite key (score falling, id
   rising, row) of the last one drawn: a round takes random pivot keys from the
   range that is left, counts exactly what lies below and at each of them, and keeps the
   stretch between two pivots.  Rows that are left are read from the written narrow table.
5. Winners alone are range-partitioned, sorted and ranked.

Null texts have no words.  A null id hashes like an empty one and comes before others of its
score.  Rows that repeat are drawn one by one; which of fully equal rows are drawn doesn't
show.  Of tables without documents, or with none long enough, nothing is drawn.
"""

from __future__ import annotations

import math
import string
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_sum
from .common import text_or_empty, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RUNS, BUCKETS, MIN_WORDS, SHARE, SEED = 1, 10_000, 20, (10, 100), 2024
#: pivot keys of a round; rows that the driver may sort at the end
PIVOTS, FEW = 16, 1000
SCALE, HASHES = 1000, 1 << 32


def words_of(text_col: str) -> Column:
    lowered = F.translate(text_or_empty(text_col), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def features_of(words: Column, runs: int) -> Column:
    """All runs of 1 to ``runs`` consecutive words, joined by one space."""
    def of_length(n):
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - F.lit(n - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.array_join(F.slice(words, at, n), " "))
    return F.concat(words, *[of_length(n) for n in range(2, runs + 1)])


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, text_col: str, runs: int, buckets: int) -> list[int]:
    """Features in each bucket."""
    words = texts.select(words_of(text_col).alias("_words"))
    found = words.select(F.explode(features_of(F.col("_words"), runs)).alias("_feature"))
    rows = found.groupBy(bucket_of(F.col("_feature"), buckets).alias("bucket")).count().collect()
    counts = dict((r.bucket, r["count"]) for r in rows)
    return [counts.get(k, 0) for k in range(buckets)]


def gains(corpus: list[int], target: list[int], buckets: int) -> list[int]:
    everywhere, wanted = sum(corpus) + buckets, sum(target) + buckets
    return [math.floor(SCALE * math.log((float(t + 1) * float(everywhere)) / (float(s + 1) * float(wanted))))
            for s, t in zip(corpus, target)]


def score_documents(docs: DataFrame, gain: list[int], runs: int = RUNS, seed: int = SEED, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) per row, all but the id long."""
    array = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    rows = docs.select(F.col(id_col).alias("id"), words_of(text_col).alias("_words"))
    rows = rows.select("id", F.size("_words").cast("bigint").alias("n_words"),
                       features_of(F.col("_words"), runs).alias("_features"))
    rows = rows.select("id", "n_words", F.size("_features").cast("bigint").alias("n_features"), F.aggregate(
        "_features", F.lit(0).cast("bigint"),
        lambda total, f: total + F.get(array, bucket_of(f, len(gain)))).alias("_sum"))
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(
        F.expr("(_sum - pmod(_sum, n_features)) div n_features")).cast("bigint")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-SCALE * F.log(-F.log((h + 0.5) / float(HASHES)))).cast("bigint")
    return rows.select("id", "n_words", "n_features", weight.alias("weight"), (weight + gumbel).alias("score"))


def _key() -> Column:
    return F.struct((-F.col("score")).alias("k0"), F.col("id").alias("k1"), F.col("_row").alias("k2"))


def _literal(key, kinds) -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(f"k{n}") for n, (v, t) in enumerate(zip(key, kinds))])


def _order(key) -> tuple:
    return key[0], key[1] is not None, key[1] if key[1] is not None else 0, key[2]


def kth_key(rows: DataFrame, k: int, seed: int = SEED, pivots: int = PIVOTS, few: int = FEW):
    """The key of rank ``k`` (from 1) of ``rows`` (id, score, _row), a written table whose
    _row is unique."""
    kinds = ["bigint", rows.schema["id"].dataType, "bigint"]
    low = high = None
    left, turn = rows.count(), 0
    assert 1 <= k <= left
    while True:
        here = rows.select("id", "score", "_row")
        if low is not None:
            here = here.where((F.col("score") <= -low[0]) & (_key() > _literal(low, kinds)))
        if high is not None:
            here = here.where((F.col("score") >= -high[0]) & (_key() < _literal(high, kinds)))
        keys = here.select(_key().alias("k"))
        if left <= few:
            return sorted((tuple(r.k) for r in keys.collect()), key=_order)[k - 1]
        picked = here.select(_key().alias("k")).orderBy(
            F.xxhash64(F.lit(seed), F.lit(turn), F.col("k.k0"), F.col("k.k1"), F.col("k.k2"))).limit(pivots).collect()
        ordered = sorted((tuple(r.k) for r in picked), key=_order)
        at = [_literal(p, kinds) for p in ordered]
        counts = keys.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(F.col("k") < p).alias(f"below{i}") for i, p in enumerate(at)],
            *[F.count_if(F.col("k") == p).alias(f"equal{i}") for i, p in enumerate(at)]).first()
        skip, end = 0, counts["n"]
        for i, p in enumerate(ordered):
            below, upto = counts[f"below{i}"], counts[f"below{i}"] + counts[f"equal{i}"]
            if below < k <= upto:
                return p
            if upto < k:
                low, skip = p, upto
            else:
                high, end = p, below
                break
        k, left, turn = k - skip, end - skip, turn + 1


def resample(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, share: tuple[int, int] = SHARE, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Per row: id, n_features, weight, score, rank (1, 2, ... of the drawn rows, else null)."""
    gain = gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, target_col, runs, buckets),
                 buckets)
    rows = written(score_documents(docs, gain, runs, seed, id_col, text_col)
                   .withColumn("_row", F.monotonically_increasing_id()), "weights")
    long_enough = rows.where(F.col("n_words") >= min_words)
    k = math.floor(Fraction(*share) * long_enough.count())
    out = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    if k == 0:
        return rows.select(*out, F.lit(None).cast("bigint").alias("rank"))
    kinds = ["bigint", rows.schema["id"].dataType, "bigint"]
    drawn = (F.col("n_words") >= min_words) & (_key() <= _literal(kth_key(long_enough, k, seed), kinds))
    winners = rows.where(drawn).select("id", "n_features", "weight", "score", "_row",
                                       (-F.col("score")).alias("_falling"), F.lit(1).alias("_one"))
    ranked = running_sum(winners, ["_falling", "id", "_row"], "_one", "rank")
    return ranked.select(*out, "rank").unionByName(
        rows.where(~drawn).select(*out, F.lit(None).cast("bigint").alias("rank")))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                    spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB has no CRC-32: a table of 256 rows by the rule, then a fold over each distinct word's bytes.
ORACLE = rf"""
WITH RECURSIVE steps(b, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, unnest([coalesce(text, '')]) AS text FROM documents),
lowered AS (SELECT r, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS text FROM d),
own AS (SELECT r, unnest(regexp_extract_all(text, '{WORD}')) AS w FROM lowered),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}',
    '{string.ascii_lowercase}'), '{WORD}')) AS w FROM benchmark),
words AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM own UNION ALL SELECT w FROM wanted)),
hashed AS (SELECT w, xor(list_reduce(
    list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
    lambda a, v: xor(crc.t[(xor(a, v) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS b
  FROM words, crc),
s AS (SELECT b, count(*) AS n FROM own JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM wanted JOIN hashed USING (w) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE)
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS g
  FROM (SELECT b FROM s UNION SELECT b FROM t) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
sums AS (SELECT r, count(*) AS n, sum(g) AS g FROM own JOIN hashed USING (w) JOIN gain USING (b) GROUP BY r),
weighed AS (SELECT d.doc_id, d.r, coalesce(n, 0)::BIGINT AS n_features,
    coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS gumbel
  FROM d LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + gumbel AS score FROM weighed),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS k, count(*) OVER () AS n
  FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score,
  CASE WHEN k <= {SHARE[0]} * n // {SHARE[1]} THEN k END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
