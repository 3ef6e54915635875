"""Token counts with a digest cache.

1. Per document a narrow row: SHA-256 of the content (null counts as empty; the
   content is else taken as it is, so that a count belongs to exactly one text),
   its bytes.  The cache is a Parquet table (content, tokenizer, n_tokens) keyed
   by that digest and the tokenizer version, the digest of the tokenizer file.
2. Contents without a row of this tokenizer in the cache are misses.  Each
   distinct miss travels once per task that holds it, is encoded once by the
   tokenizer's own library, and its count is appended to the cache.
3. The narrow rows are joined to the cache.  Both sides are written tables, so
   a content that a third of the documents share is split.

A run that is repeated or broken off appends a count twice at most; equal rows
of the cache count once.  Ids are carried along and may be null or repeat.
"""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, scratch_path
from .common import text_or_empty, written

LIMIT = 4096
CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"
_LOADED: dict = {}


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str):
    """texts -> numbers of tokens, by the library of the file: sentencepiece
    for .model, tokenizers for .json; loaded once per Python worker."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer
            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _LOADED[path] = lambda texts: [len(model.encode(t, add_special_tokens=False).ids)
                                           for t in texts]
    return _LOADED[path]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Distinct (content, n_tokens) of one tokenizer version."""
    if not path_exists(spark, cache):
        return spark.createDataFrame([], "content binary, n_tokens long")
    return (spark.read.schema(CACHE_SCHEMA).parquet(cache)
            .where(F.col("tokenizer") == version).select("content", "n_tokens"))


def append_misses(docs: DataFrame, path: str, cache: str, text_col: str = "text") -> None:
    """Encode the distinct contents that the cache lacks and append their counts."""
    spark = docs.sparkSession
    version = tokenizer_version(path)
    texts = docs.select(text_or_empty(text_col).alias("_text")).select(
        F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("content"), "_text")
    # copies meet inside each task first, then one text per task and content
    misses = texts.groupBy("content").agg(F.first("_text").alias("_text"))
    if path_exists(spark, cache):
        misses = misses.join(read_cache(spark, cache, version), "content", "left_anti")

    def encode(batches):
        count = counter(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([version] * len(n)), pa.array(n, pa.int64())],
                    ["content", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    append_misses(docs, path, cache, text_col)
    rows = written(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).select(
        "_id", F.octet_length("_text").cast("bigint").alias("n_bytes"),
        F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("content")), "content-digests")
    stored = read_cache(spark, cache, tokenizer_version(path)).groupBy("content").agg(
        F.first("n_tokens").alias("n_tokens"))
    return rows.join(written(stored, "stored-counts"), "content").select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first: the figures are those of a full
    encoding, whatever ran before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"),
                        scratch_path(spark, "token-cache"))
