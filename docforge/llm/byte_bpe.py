"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Texts are split into pre-tokens, each match of the pattern, and gathered in
   blocks of some megabytes of text.  Each distinct word of a block is exploded
   once, with its number in the block, to a bucket by its hash; the block's words
   of one bucket travel packed in a row.  The block's own rows hold the words'
   numbers of its documents in position order; they are carried along.  A word goes once per block at
   most, so no word is hot, however common it is.
2. The words of all blocks are shuffled by bucket.  Equal words meet there, and
   each distinct word is encoded once by the rank table.
3. The ids are joined back to every block that sent the word, and each block's
   documents are put together by position.
4. Decoding is the join of ids with the token-byte table, whose size is fixed by
   the vocabulary: ``decode`` explodes ids with their positions, joins the table
   by broadcast and concatenates by position.  Where documents are put together
   the same table is joined to their ids inside the task.

A task holds the distinct words of a bucket, of which there are four per shuffle
partition, or one block.  A text is never cut; one longer than a block is a block
of its own.  Null texts count as empty.  Ids of documents are carried along and may
be null or repeat.  A task that is run again must see its rows in the same order,
as in a scan of files; other inputs have to be written before (``stable=False``).
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import text_or_empty, written

#: characters of text after which a block is closed; pre-tokens of documents in a
#: row of their word numbers, and words put together at once
BLOCK, PIECE = 24_000_000, 150_000
COLUMNS = ["block", "piece", "numbers", "lengths", "tokens", "ids", "sizes", "order"]
_LOADED: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def word_encoder(path: str):
    """word -> ids by the merges of the rank file; loaded once per Python worker."""
    if path not in _LOADED:
        import tiktoken
        _LOADED[path] = tiktoken.Encoding(path, pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path),
                                          special_tokens={}).encode_ordinary
    return _LOADED[path]


def squeeze(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _steps(rising: np.ndarray) -> bytes:
    return squeeze(np.diff(rising, prepend=0))


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def explode_words(docs: DataFrame, id_col: str, text_col: str, pattern: str, block: int) -> DataFrame:
    """Rows of two kinds: (block, bucket, numbers, lengths, words), and the block's
    own (block, bucket, piece, ids, sizes, order), the ids and numbers of pre-tokens
    of some of its documents and the word numbers by position; their bucket is any."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    arrow = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("piece", pa.int32()),
                       ("numbers", pa.binary()),
                       ("lengths", pa.binary()), ("words", pa.binary()),
                       ("ids", pa.list_(to_arrow_type(id_type))), ("sizes", pa.list_(pa.int32())),
                       ("order", pa.binary())])
    source = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    buckets = 4 * _partitions(spark)

    def batch(**cols):
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([
            pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type)
            for f in arrow], schema=arrow)

    def close(key, ids, seen, order):
        counts = np.bincount(np.concatenate(order), minlength=len(seen))
        by_count = np.argsort(-counts, kind="stable")
        rank = np.empty(len(seen), np.uint32)
        rank[by_count] = np.arange(len(seen))       # small numbers for common words
        words = np.array(list(seen), object)[by_count]
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        place = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[place], return_index=True)
        for k, a, b in zip(used.tolist(), first, [*first[1:], len(place)]):
            own = place[a:b]
            parts = words[own].tolist()
            yield batch(block=[key], bucket=[k], numbers=[_steps(own)],
                        lengths=[squeeze(np.fromiter(map(len, parts), np.uint32, len(parts)))],
                        words=[zstandard.compress("".join(parts).encode(), 3)])
        at = 0
        while at < len(ids):
            to, n = at, 0
            while to < len(ids) and (to == at or n + len(order[to]) <= PIECE):
                n += len(order[to])
                to += 1
            part = order[at:to]
            yield batch(block=[key], bucket=[zlib.crc32(f"{key} {at}".encode()) % buckets], piece=[at],
                        ids=[ids[at:to]], sizes=[[len(x) for x in part]],
                        order=[squeeze(rank[np.concatenate(part)])])
            at = to

    def split(batches):
        from pyspark import TaskContext
        key = TaskContext.get().partitionId() << 32
        find = regex.compile(pattern).findall
        ids, order, seen, chars = [], [], {}, 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if ids and chars + len(text) > block:
                    yield from close(key, ids, seen, order)
                    key, ids, order, seen, chars = key + 1, [], [], {}, 0
                words = find(text)
                order.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words),
                                         np.uint32, len(words)))
                ids.append(doc)
                chars += len(text)
        if ids:
            yield from close(key, ids, seen, order)

    kind = id_type.simpleString()
    return source.mapInArrow(split, "block long, bucket int, piece int, numbers binary, lengths binary, "
                             f"words binary, ids array<{kind}>, sizes array<int>, `order` binary")


def encode_words(rows: DataFrame, path: str) -> DataFrame:
    """COLUMNS: a row for each row of ``rows``, the words replaced by their ids; a
    block's own rows as they are."""
    kind = rows.schema["ids"].dataType

    def ids_of(encode, known, lengths, data):
        text, at, ids = zstandard.decompress(data).decode(), 0, []
        for n in unsqueeze(lengths).tolist():
            word = text[at:at + n]
            at += n
            got = known.get(word)
            if got is None:
                got = known[word] = encode(word)
            ids.append(got)
        return (squeeze(np.fromiter(map(len, ids), np.uint32, len(ids))),
                squeeze(np.array([x for part in ids for x in part], np.uint32)))

    def run(batches):
        encode, known, last = word_encoder(path), {}, None
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                block, bucket, piece, numbers, lengths, words, ids, sizes, order = row.columns
                if bucket[0].as_py() != last:
                    known, last = {}, bucket[0].as_py()
                got = (ids_of(encode, known, lengths[0].as_py(), words[0].as_py())
                       if words[0].is_valid else (None, None))
                yield pa.RecordBatch.from_arrays(
                    [block, piece, numbers, *(pa.array([x], pa.binary()) for x in got),
                     ids, sizes, order], COLUMNS)

    return (rows.repartition(_partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "block long, piece int, numbers binary, lengths binary, tokens binary, "
                        f"ids {kind.simpleString()}, sizes array<int>, `order` binary"))


def _pieces(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches (start, length) of ``flat``, one after the other."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


class TokenBytes:
    """The token-byte table as arrays, to join ids by their number."""

    def __init__(self, path: str):
        table = {rank: token for token, rank in read_ranks(path).items()}
        tokens = [table.get(k, b"") for k in range(max(table) + 1)]
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(_pieces(self.flat, self.start[part], self.length[part]).tobytes()
                        for part in (ids[k:k + PIECE] for k in range(0, len(ids), PIECE)))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN,
           id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
           stable: bool = True) -> DataFrame:
    """Per row: id, token_ids array<int>, decoded binary (the ids decoded again)."""
    spark = docs.sparkSession
    if not stable:
        docs = written(docs.select(id_col, text_col), "texts")
    packed = encode_words(explode_words(docs, id_col, text_col, pattern, block), path)
    id_type = docs.schema[id_col].dataType
    arrow = pa.schema([(id_col, to_arrow_type(id_type)), ("token_ids", pa.list_(pa.int32())),
                       ("decoded", pa.binary())])

    def word_ids(rows):
        """(flat ids, start and length by word number) of a block's words."""
        tokens = [unsqueeze(r["tokens"]) for r in rows]
        lengths = [unsqueeze(r["lengths"]).astype(np.int64) for r in rows]
        numbers = [np.cumsum(unsqueeze(r["numbers"])) for r in rows]
        if not rows:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        number, every = np.concatenate(numbers), np.concatenate(lengths)
        start, length = np.empty_like(every), np.empty_like(every)
        start[number], length[number] = np.cumsum(every) - every, every
        return np.concatenate(tokens), start, length

    def documents(row, flat, start, length, table):
        order, at = unsqueeze(row["order"]), 0
        ids, texts = [], []
        for n in row["sizes"]:
            words = order[at:at + n]
            at += n
            got = np.concatenate([_pieces(flat, start[part], length[part]) for part in
                                  (words[k:k + PIECE] for k in range(0, max(1, n), PIECE))])
            ids.append(got.astype(np.int32))
            texts.append(table.text(got))
        return pa.RecordBatch.from_arrays([
            pa.array(c, f.type) for c, f in zip((row["ids"], ids, texts), arrow)], schema=arrow)

    def assemble(batches):
        """A block's words come first, then its documents."""
        table, last, words, joined = TokenBytes(path), None, [], None
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(i)[k].as_py() for i, c in enumerate(COLUMNS)}
                if row["block"] != last:
                    last, words, joined = row["block"], [], None
                if row["order"] is None:
                    words.append(row)
                    continue
                if joined is None:
                    joined, words = word_ids(words), []
                yield documents(row, *joined, table)

    # blocks grow with the scan's partitions, whatever the number of shuffle partitions
    tasks = max(_partitions(spark), 4 * docs.rdd.getNumPartitions())
    return (packed.repartition(tasks, "block").sortWithinPartitions("block", "piece")
            .mapInArrow(assemble, f"{id_col} {id_type.simpleString()}, token_ids array<int>, decoded binary"))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(token, bytes): one row for each rank."""
    return spark.createDataFrame([(r, bytearray(b)) for b, r in read_ranks(path).items()],
                                 "token int, bytes binary")


def decode(rows: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids (null for null ids)."""
    spark = rows.sparkSession
    kept = written(rows.withColumn("_row", F.monotonically_increasing_id()), "id-rows")
    parts = kept.select("_row", F.posexplode(ids_col).alias("_at", "token"))
    parts = parts.join(F.broadcast(token_table(spark, path)), "token")
    text = parts.groupBy("_row").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "bytes"))), lambda x: F.hex(x["bytes"])), "")
        .alias("_hex"))
    empty = F.when(F.col(ids_col).isNotNull(), F.lit("").cast("binary"))
    return kept.join(text, "_row", "left").withColumn(
        out_col, F.coalesce(F.unhex("_hex"), empty)).drop("_row", "_hex")


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return rows.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256)
        .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
