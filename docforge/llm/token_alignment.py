"""Alignment of two tokenizers' tokens by diagonal run skipping, with corpus-wide link counts.

Tokenizer A is byte-level and reads a space and the text, tokenizer B adds that space
itself.  Of each document:

1. Both token sequences are laid over the bytes they stand for.  ``align`` walks the two
   arrays of end offsets.  While they run one to one, the index shift b - a stays and
   exponential probing compares stretches of doubling length at that shift, so a run is
   jumped in a few comparisons.  Where the ends differ, the group is resolved locally
   by stepping the side that is behind, and the shift is that of the next common end.
2. A common end closes a group.  The A token and the B token that end there are a link.

Then over the corpus:

3. Documents are gathered in blocks of some megabytes.  A block emits its documents'
   tokens and group sizes, and each of its distinct id pairs once, with a count.  A pair
   that every document has is therefore one row per block, and never hot.
4. Pair counts are summed and compared with the highest of their B id.
5. The counts of a block's pairs are joined back and meet its documents, by block, and
   each document's links are scored from them.

Null and empty texts, and texts whose joined token bytes on either side are not the space
and the text, have no tokens.  Repeated rows are documents of their own, ids are carried
along and may be null, and a text met again in its block is not encoded again.  A text
over ``PART`` characters is encoded in parts that both libraries can't tell from the
whole: they are cut at a space between two ASCII letters, where neither tokenizer joins.
A byte-level vocabulary whose merges come in the order of their ids is a rank table, which
tiktoken encodes by, five times as fast; texts with characters on whose class libraries
may differ go through the library of the file itself.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .byte_bpe import squeeze, unsqueeze
from .common import text_or_empty, written

#: characters of text that close a block, that are encoded at once, in a part of a text, and
#: of texts that are kept to meet their copies
BLOCK, CHUNK, PART, KEPT = 16_000_000, 500_000, 1_000_000, 4_000_000
#: tokens that are joined at once, links that are counted at once
PIECE, COUNTED = 500_000, 2_000_000
CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: a character outside of Latin letters, digits and marks whose classes are settled
UNUSUAL = re.compile("[^\t\n\r -~\u00a1-\u024f\u2010-\u2027]")
PACKED = ["a_ids", "b_ids", "a_sizes", "b_sizes"]
_LOADED: dict = {}


def byte_level_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 characters stand
    for themselves, the other bytes in order for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """ids of a space and the text by a byte-level file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.path, spec = path, json.load(f)
        byte, model = byte_level_alphabet(), spec["model"]
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        vocabulary = {k: t for t, k in model["vocab"].items()}
        self.bytes = [special[k] if k in special else bytes(byte[c] for c in vocabulary[k])
                      for k in range(max([*vocabulary, *special]) + 1)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [model["vocab"]["".join(m)] for m in pairs]
        split = spec["pre_tokenizer"] or {}
        self._ranks = None
        if (merged == sorted(merged) and len(merged) + 256 + len(special) == len(self.bytes)
                and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not spec["normalizer"]):
            import tiktoken
            self._ranks = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
                b: k for k, b in enumerate(self.bytes) if k not in special}).encode_ordinary
        self._library = None
        #: the ids of a text always spell it
        self.lossless = not spec["normalizer"]

    def library(self, text: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
            self._library.encode_special_tokens = True
        return self._library.encode(" " + text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.library(t) if self._ranks is None or UNUSUAL.search(t) else self._ranks(" " + t) for t in texts]


class Tokens:
    """A tokenizer of two: ``encode`` gives the ids of texts, ``bytes`` a token's bytes."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode()
                          for k, p in enumerate(pieces)]
            self.lossless = False
            #: no piece goes on behind a space
            self.parts = not any(re.search("[^▁]▁", p) for p in pieces)
        else:
            model = ByteLevel(path)
            self.encode, self.bytes, self.parts, self.lossless = model.encode, model.bytes, True, model.lossless
        self.length = np.array([len(b) for b in self.bytes], np.int64)

    def spells(self, ids: list[int], want: bytes) -> bool:
        if self.lossless:
            return True
        at, every = 0, iter(ids)
        while part := list(islice(every, PIECE)):
            got = b"".join(map(self.bytes.__getitem__, part))
            if want[at:at + len(got)] != got:
                return False
            at += len(got)
        return at == len(want)


def tokens(path: str) -> Tokens:
    """Loaded once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def parts(text: str, size: int) -> list[str]:
    """Stretches of at least ``size`` characters between the spaces that may be cut."""
    out, start = [], 0
    while len(text) - start > size and (cut := CUT.search(text, start + size)):
        out.append(text[start:cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def run_length(a: bytes, b: bytes, x: int, y: int, width: int = 8) -> int:
    """For how many places a from byte ``x`` on and b from ``y`` on agree, the first of which does:
    exponential probing; the first difference is the lowest bit in which a stretch differs."""
    most = min(len(a) - x, len(b) - y)
    at, step = width, 8 * width
    while at < most:
        p, q = a[x + at:x + at + min(step, most - at)], b[y + at:y + at + min(step, most - at)]
        if p != q:
            differ = int.from_bytes(p, "little") ^ int.from_bytes(q, "little")
            return (at + ((differ & -differ).bit_length() - 1) // 8) // width
        at += step
        step *= 2
    return most // width


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising end offsets (int64) with the same last one -> per group, the number of tokens of a
    and of b up to its end."""
    bytes_a, bytes_b = a.tobytes(), b.tobytes()
    ends_a, ends_b = memoryview(bytes_a).cast("q"), memoryview(bytes_b).cast("q")
    i = j = 0
    n, m = len(a), len(b)
    stretches: list[int] = []       # a common end, and what runs on one to one from it: i, j, length
    while i < n and j < m:
        x, y = ends_a[i], ends_b[j]
        while x != y:               # an irregular group: the side behind steps on
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        run = run_length(bytes_a, bytes_b, i * 8, j * 8)
        stretches += i, j, run
        i += run
        j += run
    at = np.array(stretches, np.int64).reshape(-1, 3)
    length = at[:, 2]
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(at[:, 0] + 1, length) + within, np.repeat(at[:, 1] + 1, length) + within


def _sizes(cuts: np.ndarray) -> np.ndarray:
    return np.diff(cuts, prepend=0).astype(np.int32)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs), both written.

    documents: block, id, a_ids, b_ids, a_sizes, b_sizes: the tokens, and how many of them each
    group has, packed (``token_arrays`` makes arrays of them).  pairs: block, a, b, n, the
    links of a block by id pair."""
    id_type = docs.schema[id_col].dataType
    arrow = pa.schema([("block", pa.int64()), ("id", to_arrow_type(id_type)),
                       *((c, pa.binary()) for c in PACKED),
                       ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
    none = np.zeros(0, np.int32)

    def batch(**cols):
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([
            pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def encoded(side, texts):
        cut = [parts(t, PART) if side.parts else [t] for t in texts]
        got = iter(side.encode([p for t in cut for p in t]))
        return [list(next(got)) if len(t) == 1 else [k for _ in t for k in next(got)] for t in cut]

    def groups_of(text, a_ids, b_ids, a, b):
        """The four arrays, packed, and the links' codes."""
        want = b" " + text.encode()
        if not (a.spells(a_ids, want) and b.spells(b_ids, want)):
            return empty
        a_ids, b_ids = np.array(a_ids, np.int32), np.array(b_ids, np.int32)
        cuts = align(np.cumsum(a.length[a_ids]), np.cumsum(b.length[b_ids]))
        packed = [squeeze(x) for x in (a_ids, b_ids, _sizes(cuts[0]), _sizes(cuts[1]))]
        return (*packed, a_ids[cuts[0] - 1].astype(np.int64) << 32 | b_ids[cuts[1] - 1])

    empty = (*[squeeze(none)] * 4, none.astype(np.int64))

    def run(batches):
        from pyspark import TaskContext
        a, b = tokens(path_a), tokens(path_b)
        key = TaskContext.get().partitionId() << 32
        seen: dict[bytes, tuple] = {}
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        chars, kept, waiting = 0, 0, []

        def count():
            nonlocal codes, counts
            every, at = np.unique(np.concatenate([codes, *waiting]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.ones(len(at) - len(counts), np.int64)]),
                                 len(every)).astype(np.int64)
            codes = every
            waiting.clear()

        def documents(ids, texts):
            nonlocal kept
            digests = [hashlib.sha256(t.encode()).digest() for t in texts]
            new = list({d: t for d, t in zip(digests, texts) if t and d not in seen}.items())
            own = {}
            for (d, t), x, y in zip(new, encoded(a, [t for _, t in new]), encoded(b, [t for _, t in new])):
                own[d] = groups_of(t, x, y, a, b)
                if kept < KEPT and len(t) < CHUNK:      # a copy met again is not encoded again
                    seen[d] = own[d]
                    kept += len(t)
            rows = [own.get(d) or seen[d] if t else empty for d, t in zip(digests, texts)]
            waiting.extend(r[4] for r in rows)
            if sum(map(len, waiting)) > COUNTED:
                count()
            return batch(block=[key] * len(ids), id=ids, **{c: [r[k] for r in rows] for k, c in enumerate(PACKED)})

        def pairs():
            count()
            for at in range(0, len(codes), 100_000):
                part = codes[at:at + 100_000]
                yield batch(block=np.full(len(part), key), a=(part >> 32).astype(np.int32),
                            b=(part & 0xFFFFFFFF).astype(np.int32), n=counts[at:at + 100_000])

        ids, texts, size = [], [], 0
        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                text = text.as_py()
                if ids and size + len(text) > CHUNK:
                    yield documents(ids, texts)
                    ids, texts, size = [], [], 0
                    if chars + len(text) > block:
                        yield from pairs()
                        key, seen, kept, chars = key + 1, {}, 0, 0
                        codes, counts = codes[:0], counts[:0]
                ids.append(doc)
                texts.append(text)
                size += len(text)
                chars += len(text)
        if ids:
            yield documents(ids, texts)
        yield from pairs()

    rows = written(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).mapInArrow(
        run, f"block long, id {id_type.simpleString()}, {', '.join(c + ' binary' for c in PACKED)}, "
             "a int, b int, n long"), "aligned")
    return (rows.where("n IS NULL").select("block", F.col("id").alias(id_col), *PACKED),
            rows.where("n IS NOT NULL").select("block", "a", "b", "n"))


def token_arrays(documents: DataFrame) -> DataFrame:
    """The documents with their packed columns as array<int>."""
    @F.pandas_udf("array<int>")
    def unpacked(packed: pd.Series) -> pd.Series:
        return packed.map(lambda x: unsqueeze(x).astype(np.int32))
    return documents.withColumns({c: unpacked(c) for c in PACKED})


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): the links of each id pair, and whether no pair of its B id has
    more.  Written."""
    counts = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("_most"))
    return written(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best")),
                   "scored-pairs")


def _decimals(path_a: str, path_b: str) -> np.ndarray:
    """Decimal ids with what follows them, a comma, a bar or a semicolon, filled up with zero bytes."""
    key = ("decimals", path_a, path_b)
    if key not in _LOADED:
        n = max(len(tokens(path_a).bytes), len(tokens(path_b).bytes))
        _LOADED[key] = np.array([b"%d%s" % (k, end) for end in (b",", b"|", b";") for k in range(n)])
    return _LOADED[key]


def groups_digest(a_ids, b_ids, a_sizes, b_sizes, decimals: np.ndarray) -> str:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3``; the empty text without tokens."""
    if not len(a_sizes):
        return ""
    ends_a, ends_b, n = np.cumsum(a_sizes), np.cumsum(b_sizes), len(decimals) // 3
    order = np.empty(len(a_ids) + len(b_ids), np.int32)
    a, b = a_ids.copy(), b_ids.copy()
    a[ends_a - 1] += n
    b[ends_b - 1] += 2 * n
    order[np.arange(len(a)) + np.repeat(ends_b - b_sizes, a_sizes)] = a
    order[np.arange(len(b)) + np.repeat(ends_a, b_sizes)] = b
    digest = hashlib.sha256()
    for at in range(0, len(order), PIECE):
        part = decimals[order[at:at + PIECE]].tobytes().translate(None, b"\0")
        digest.update(part[:-1] if at + PIECE >= len(order) else part)
    return digest.hexdigest()


def score_links(documents: DataFrame, pairs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    id_type = documents.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)

    def links(batches):
        decimals = _decimals(path_a, path_b)
        for rows in batches:
            for at in range(0, rows.num_rows, 64):
                part = rows.slice(at, 64)
                docs = [[unsqueeze(c[k].as_py()).astype(np.int32) for c in part.columns[2:]] for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1),
                    *(pa.array([len(d[k]) for d in docs], pa.int64()) for k in (0, 1, 2)),
                    pa.array([groups_digest(*d, decimals) for d in docs], pa.string()),
                    *(pa.array([squeeze(d[k][np.cumsum(d[k + 2]) - 1]) for d in docs], pa.binary()) for k in (0, 1))],
                    ["block", "id", "n_a", "n_b", "n_groups", "groups_sha256", "link_a", "link_b"])

    own = documents.select("block", F.col(id_col).alias("id"), *PACKED).mapInArrow(
        links, f"block long, id {id_type.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, "
               "link_a binary, link_b binary")
    known = pairs.select(F.col("block").alias("of"), "a", "b").join(pair_counts(pairs), ["a", "b"])

    def score(docs, known):
        codes = known.column("a").to_numpy().astype(np.int64) << 32 | known.column("b").to_numpy()
        order = np.argsort(codes)
        codes, count = codes[order], known.column("count").to_numpy()[order]
        best = known.column("best").to_numpy()[order].astype(bool)
        n_links, n_best, total = [], [], []
        for a, b in zip(docs.column("link_a"), docs.column("link_b")):
            want = unsqueeze(a.as_py()).astype(np.int64) << 32 | unsqueeze(b.as_py())
            at = np.searchsorted(codes, want)
            n_links.append(len(want))
            n_best.append(int(best[at].sum()) if len(at) else 0)
            total.append(int(count[at].sum()) if len(at) else 0)
        return pa.table([docs.column("id").cast(arrow_id), docs.column("n_a"), docs.column("n_b"),
                         docs.column("n_groups"), pa.array(n_links, pa.int64()), pa.array(n_best, pa.int64()),
                         pa.array(total, pa.int64()), docs.column("groups_sha256")],
                        [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    # a task for every few blocks, however many there are
    n = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")),
            pairs.select("block").distinct().count() // 2)
    own, known = own.repartition(n, "block"), known.repartition(n, "of")
    return own.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        score, f"{id_col} {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
               "count_sum long, groups_sha256 string")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sides = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return score_links(*align_documents(docs, *sides), *sides)
