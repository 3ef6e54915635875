"""WARC archives of pages, compressed record by record with a shared dictionary.

1. Payloads: html in UTF-8 (null counts as empty).  Equal payloads of at least
   ``least`` bytes are found by narrow rows (SHA-1, length, a second hash) under
   partial aggregation; the largest page id of each group is its response, the
   others are revisits of it.  Only groups of two or more are joined back, by
   broadcast if their rows are counted to be few, else by a shuffle join.
2. A Zstandard dictionary is trained on a bounded sample of records and pieces of
   long ones; a tiny table has none, its dictionary frames are empty.  Every
   partition becomes an archive: a leading skippable frame (magic 0x184D2A5D)
   that embeds the dictionary, then one Zstandard frame per WARC record.
3. Spark's own text writer commits the archives, so a task that runs twice leaves
   one file, on any file system Spark writes to.  What it puts after each
   row is an empty skippable frame, which decoders pass over: the files are
   plain ``.warc.zst`` streams whatever their extension.
4. The reader takes an archive, loads the dictionary from its first frame, and
   parses the records; digests of responses are checked against the payload.

Empty tables give no archive records.  Null urls are written as empty.  Of rows
that repeat the response's page id and payload, each is written as a response.  A
row without page id revisits a response that has one; if no row of the group
has one, all are responses.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import bounded_sample, text_or_empty, written

LEAST = 1000
LEVEL, DICTIONARY = 6, 112_640
#: records or pieces that the dictionary is trained on at most, and the longest of them
SAMPLE, SAMPLE_BYTES = 1000, 32_768
#: revisit groups joined by broadcast at most (some 100 bytes each)
BROADCAST_ROWS = 200_000

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
PAGE_URN = "urn:page:"

ROW = ("page_id long, url string, payload_bytes long, payload_digest string, "
       "record_type string, refers_to long")


def record(page_id, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header without the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    name = lambda x: f"<{PAGE_URN}{'' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {quote(url or '', safe='%' + _URI)}",
            f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI = "".join(map(chr, range(33, 127)))


def parse(stream) -> "iter":
    """Yields (headers, block) of the WARC records of a binary stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            head[key.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("WARC record without its end")
        yield head, block


def read_archive(data: bytes):
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload) of an archive; the payload of a revisit is None."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("archive without its dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(data[8:8 + size]) if size else None
    number = lambda urn: int(x) if (x := urn[len(PAGE_URN) + 1:-1]) else None
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    with decoder.stream_reader(io.BytesIO(data), read_across_frames=True) as plain:
        for head, block in parse(io.BufferedReader(plain, 1 << 20)):
            http, _, payload = block.partition(b"\r\n\r\n")
            length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n")
                          if x.lower().startswith(b"content-length"))
            digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2])
            revisit = head["warc-type"] == "revisit"
            if not revisit and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
                raise ValueError(f"payload of {head['warc-record-id']} is damaged")
            yield (number(head["warc-record-id"]), head["warc-target-uri"], length, digest.hex(),
                   head["warc-type"], number(head["warc-refers-to"]) if revisit else None,
                   None if revisit else payload)


def revisit_groups(pages: DataFrame, least: int, id_col: str, html_col: str) -> DataFrame:
    """(_sha, _bytes, _check, _response) of payloads that several rows share."""
    return (pages.select(F.col(id_col).alias("_id"), *_payload_key(html_col))
            .where(F.col("_bytes") >= least)
            .groupBy("_sha", "_bytes", "_check")
            .agg(F.max("_id").alias("_response"), F.count(F.lit(1)).alias("_n"))
            .where("_n > 1").drop("_n"))


def _payload_key(html_col: str) -> list:
    text = text_or_empty(html_col)
    return [F.unhex(F.sha1(text.cast("binary"))).alias("_sha"),
            F.octet_length(text).alias("_bytes"), F.xxhash64(text).alias("_check")]


def train(pages: DataFrame, id_col: str, html_col: str) -> bytes:
    """Dictionary from at most SAMPLE records, longer ones in pieces of SAMPLE_BYTES;
    none for a table of fewer than 10 of these or less than 20 KB."""
    text = text_or_empty(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), text.cast("binary").alias("_html"),
                        F.xxhash64(text).alias("_hash"))
    last = F.floor((F.greatest(F.octet_length("_html"), F.lit(1)) - 1) / SAMPLE_BYTES)
    # only a piece goes on, so the whole text of a long record is in no sort
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("_piece")).select(
        "_id", "_hash", "_piece",
        F.expr(f"substring(_html, _piece * {SAMPLE_BYTES} + 1, {SAMPLE_BYTES})").alias("_part"))
    some = bounded_sample(pieces, ["_id", "_hash", "_piece"], SAMPLE, pieces.count()).toPandas()
    parts = [record(None, "", bytes(x), None, False) for x in some["_part"]]
    if sum(map(len, parts)) < 20 * 1024 or len(parts) < 10:
        return b""
    size = min(DICTIONARY, sum(map(len, parts)) // 10)
    return zstandard.train_dictionary(size, parts, k=512, d=8).as_bytes()


def write_archives(pages: DataFrame, path: str, least: int = LEAST, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html") -> None:
    """Write the archives of ``pages`` to the folder ``path``, one per partition."""
    dictionary = train(pages, id_col, html_col)
    groups = written(revisit_groups(pages, least, id_col, html_col), "revisit-groups")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    key = ["_sha", "_bytes", "_check"]
    rows = pages.select(F.col(id_col).cast("long").alias("_id"),
                        F.col(url_col).cast("string").alias("_url"),
                        text_or_empty(html_col).alias("_html"), *_payload_key(html_col))
    rows = rows.join(groups.withColumn("_shared", F.lit(True)), key, "left").select(
        "_id", "_url", "_html", F.col("_response").cast("long").alias("_response"),
        (F.col("_shared").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_response"))).alias("_revisit"))

    def archive(batches):
        used = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if used:
            used.precompute_compress(level=LEVEL)
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=used, write_content_size=True)
        frame = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["frame"])
        for b in batches:
            for at in range(0, b.num_rows, 64):
                frames = [coder.compress(record(r["_id"], r["_url"], r["_html"].encode("utf-8", "surrogatepass"),
                                                r["_response"], r["_revisit"]))
                          for r in b.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    (rows.mapInArrow(archive, "frame binary")
     .select(F.col("frame").cast("string").alias("value"))    # the bytes as they are
     .write.option("lineSep", EMPTY_FRAME.decode("latin-1")).text(path))


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives below ``path``, with the html if asked for."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [x.split()[0] for x in ROW.split(", ")] + ["html"] * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def read(batches):
        for b in batches:
            for data in b.column(0):
                part = []
                for row in read_archive(data.as_py()):
                    html = row[6].decode("utf-8", "surrogatepass") if payloads and row[6] is not None else None
                    part.append((*row[:6], html)[:len(names)])
                    if len(part) == 256:
                        yield _batch(part, names, types)
                        part = []
                if part:
                    yield _batch(part, names, types)

    return files.mapInArrow(read, ROW + (", html string" if payloads else ""))


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def op4_warc_dictionary(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
