"""Training preparation: exact seeded split (O3) and constant-length token
packing (T1).

O3: every sample gets ``h = md5(seed # key)``; the ``ceil(share * n)``
samples with the smallest ``(h, key)`` form the test split.  Only the boundary
(h, key) of that rank is looked for, by counts per prefix of h on rows of (h,
key); the samples are then labelled where they are, by comparison with it.  The
split is exact, reproducible and independent of the partitioning, and no
text is shuffled.

T1: samples are laid end to end in ``(h, key)`` order, each contributing its
token count plus one end marker; the stream is cut into blocks of
``block`` tokens and the last partial block is dropped.  Output segments
``(block_id, key, from_tok, to_tok)`` say which token range of which sample
fills which block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import render_sample
from ..functions.text import ws_tokens
from ..params import HarvestParams, MAX_SEQ_LENGTH, SPLIT_SEED, TEST_SIZE
from ..session import materialise
from .ordering import running_sum


def split_hash(key: Column, seed: int = SPLIT_SEED) -> Column:
    return F.md5(F.concat_ws("#", F.lit(str(seed)), key.cast("string")))


def test_count(n: int, share: float = TEST_SIZE) -> int:
    """ceil(share * n) computed without float error for shares given as tenths etc."""
    from fractions import Fraction
    q = Fraction(str(share)) * n
    return int(-(-q.numerator // q.denominator))


def split_boundary(keys: DataFrame, k: int, seed: int = SPLIT_SEED, few: int = 4096):
    """(hash, key) of the row of rank ``k`` (from 1) in (hash, key) order of
    ``keys`` (key), or None.  Counts per hash prefix, 4096 at most a round,
    narrow the rank down to a prefix with ``few`` rows at most."""
    # equal keys are one row with a count, so what is left under a prefix is few distinct keys
    h = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(
        split_hash(F.col("key"), seed).alias("h"), "key", "n"), "split-hashes")
    prefix, rank = "", k
    while rank > 0:
        digits = len(prefix) + 3
        counts = sorted(h.where(F.startswith("h", F.lit(prefix))).groupBy(
            F.substring("h", 1, digits).alias("p")).agg(F.sum("n"), F.count(F.lit(1))).collect())
        for part, n, distinct in counts:
            if rank <= n:
                break
            rank -= n
        else:
            return None
        prefix = part
        if distinct <= few or digits >= 30:     # 30 digits are one key, but for md5 collisions
            for row in h.where(F.startswith("h", F.lit(prefix))).orderBy("h", "key").collect():
                if rank <= row.n:
                    return row.h, row.key
                rank -= row.n
    return None


def train_test_split(df: DataFrame, key_col: str, share: float = TEST_SIZE,
                     seed: int = SPLIT_SEED) -> DataFrame:
    """O3: adds ``split`` ('train' / 'test') and ``split_hash``."""
    keys = materialise(df.select(F.col(key_col).alias("key")), "split-keys")
    bound = split_boundary(keys, test_count(keys.count(), share), seed)
    h = F.col("split_hash")
    key_type = df.schema[key_col].dataType
    test = F.lit(False) if bound is None else (h < F.lit(bound[0])) | (
        (h == F.lit(bound[0])) & (F.col(key_col) <= F.lit(bound[1]).cast(key_type)))
    return df.withColumn("split_hash", split_hash(F.col(key_col), seed)).withColumn(
        "split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def group_split(df: DataFrame, group_col: str, share: float = TEST_SIZE,
                seed: int = SPLIT_SEED) -> DataFrame:
    """O3 at group level (e.g. page): whole groups go to one side, so chunks
    of one page never straddle train and test.  The exact split runs on the
    distinct group keys, which are written so that ``df`` is not computed again for them;
    rows get their group's side by a join on the key (a hot group is handled by AQE skew-join
    splitting)."""
    distinct = materialise(df.select(group_col).distinct(), "split-groups")
    groups = train_test_split(distinct, group_col, share, seed)
    return df.join(groups.select(group_col, "split"), group_col)


def whitespace_token_count(text: Column) -> Column:
    return F.size(ws_tokens(text)).cast("bigint")


def training_lengths(samples: DataFrame, keys: list[str], p: HarvestParams = HarvestParams()) -> DataFrame:
    """(keys, n_tok): tokens of the rendered training text, by the parameters'
    formatter and token counter."""
    text = (p.formatter or render_sample)(F.col("instruction"), F.col("input"), F.col("output"))
    return samples.select(*keys, (p.token_counter or whitespace_token_count)(text).alias("n_tok"))


def pack_blocks(df: DataFrame, key_col: str, order_cols: list[str], n_tokens_col: str,
                block: int = MAX_SEQ_LENGTH, drop_last: bool = True) -> DataFrame:
    """Segments (block_id, key, from_tok, to_tok) of the packed stream."""
    cols = list(dict.fromkeys([*order_cols, key_col]))
    lens = df.select(*cols,
                     (F.col(n_tokens_col) + F.lit(1)).cast("bigint").alias("_len"))
    cum = running_sum(lens, order_cols, "_len", "_end")
    total = cum.agg(F.coalesce(F.max("_end"), F.lit(0))).first()[0]
    n_full = total // block if drop_last else -(-total // block)
    seg = cum.select(
        key_col, "_len", "_end", (F.col("_end") - F.col("_len")).alias("_start"))
    seg = seg.withColumn("block_id", F.explode(F.sequence(
        F.floor(F.col("_start") / F.lit(block)).cast("bigint"),
        F.floor((F.col("_end") - F.lit(1)) / F.lit(block)).cast("bigint"))))
    seg = seg.where(F.col("block_id") < F.lit(n_full))
    return seg.select(
        "block_id", key_col,
        (F.greatest(F.col("_start"), F.col("block_id") * block) - F.col("_start"))
        .alias("from_tok"),
        (F.least(F.col("_end"), (F.col("block_id") + 1) * block) - F.col("_start"))
        .alias("to_tok"))
