"""J4 page store: what a crawl needs of the fetched pages, by URL.

* ``index``: URL -> page id of its first page, from the narrow columns.
* ``run=K``: facts, links and text of pages, reduced from HTML where the pages lie
  (map-side), so that HTML itself never moves.  A run is committed by a marker.

Both are bucketed by URL; the number of buckets follows the number of pages.  A fetch
takes one of two ways, and the store side has no exchange in either:

* few URLs (at most half as many as buckets): they are broadcast, and only the files of
  their buckets are read;
* more: a join with the bucketed table, whose side is read where it lies.

Either way only the columns that are asked for are read.

``reduce_all`` reduces what no run has yet, ``reduce_some`` the pages of given URLs, so
that a crawl with a small budget extracts no more than it may need.

A store belongs to one input and one set of parameters (all but the budget).  Their
fingerprint is kept with it, and opening it for others is an error: it would return what
was extracted from other pages or by other rules.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import HarvestParams
from ..session import materialise
from .state import MARKER, _fs, _read_text, _write_text

INDEX = "url string, page_id long"
FACTS = ("url string, page_id long, gate_reason string, _nchunks long, _dig string, _bkeys array<string>, "
         "hrefs array<string>, text string")
#: URLs in a bucket; URLs that may be broadcast to the pages, whatever the number of buckets
BUCKET_URLS, FEW = 20_000, 100_000
#: stands for a null page id, so that it comes last and can be joined
LAST = (1 << 63) - 1
BUCKET_FILE = re.compile(r"_(\d+)(?:\..*)?$")


class StaleStore(ValueError):
    """The store was made from other pages or with other parameters."""


def parameter_text(p: HarvestParams) -> str:
    """The parameters that decide what is extracted, functions by their code."""
    def plain(v):
        return f"{v.__qualname__} {v.__code__.co_code.hex()} {v.__code__.co_consts}" if callable(v) else v
    return repr({f.name: plain(getattr(p, f.name)) for f in dataclasses.fields(p) if f.name != "max_samples"})


def input_text(pages: DataFrame) -> str:
    """Files with their sizes and times, rows and a checksum of their ids and URLs; where
    there are no files, the checksum is over the HTML too."""
    files = []
    for path in sorted(pages.inputFiles()):
        fs, hpath = _fs(pages.sparkSession, path)
        status = fs.getFileStatus(hpath)
        files.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    cols = ["page_id", "url"] if files else ["page_id", "url", "html"]
    row = pages.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("x"),
                    F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("s")).first()
    return "\n".join([*files, str(tuple(row))])


class PageStore:
    def __init__(self, pages: DataFrame, path: str, p: HarvestParams,
                 rows: Callable[[DataFrame, HarvestParams], DataFrame]):
        """``rows`` makes FACTS of pages (page_id, url, html)."""
        self.spark, self.path, self.p, self._rows = pages.sparkSession, path, p, rows
        self.pages = pages.select(F.coalesce("page_id", F.lit(LAST)).alias("page_id"), "url", "html")
        self._tables: dict[str, str] = {}
        self._files: dict[str, dict[int, list[str]]] = {}
        made = hashlib.sha256((parameter_text(p) + "\n" + input_text(self.pages)).encode()).hexdigest()
        found = _read_text(self.spark, os.path.join(path, "index", MARKER))
        meta = json.loads(found) if found else self._make_index(made)
        if meta["fingerprint"] != made:
            raise StaleStore(f"{path} was made from other pages or with other parameters; use a new state folder")
        self.buckets, self.n_urls, self.n_rows = meta["buckets"], meta["urls"], meta["rows"]
        #: pages in each committed run
        self.runs: list[int] = []
        while text := _read_text(self.spark, os.path.join(path, f"run={len(self.runs)}", MARKER)):
            self.runs.append(json.loads(text)["pages"])

    def _make_index(self, fingerprint: str) -> dict:
        first = materialise(self.pages.where("url IS NOT NULL").groupBy("url").agg(
            F.min("page_id").alias("page_id")), "first-pages")
        urls, rows = first.count(), self.pages.count()
        self.buckets = max(self.spark.sparkContext.defaultParallelism, -(-urls // BUCKET_URLS))
        self._write(first, "index", INDEX)
        meta = {"fingerprint": fingerprint, "buckets": self.buckets, "urls": urls, "rows": rows}
        _write_text(self.spark, os.path.join(self.path, "index", MARKER), json.dumps(meta))
        return meta

    # ---- bucketed tables

    def _write(self, df: DataFrame, name: str, schema: str) -> None:
        table = self._tables[name] = f"docforge_{uuid.uuid4().hex}"
        columns = T._parse_datatype_string(schema).fieldNames()
        (df.select(*columns).repartition(self.buckets, "url").sortWithinPartitions("url")
         .write.mode("overwrite").bucketBy(self.buckets, "url").sortBy("url")
         .option("path", os.path.join(self.path, name)).saveAsTable(table))

    def table(self, name: str) -> DataFrame:
        """A bucketed table, by its entry in this session's catalog."""
        if name not in self._tables:
            table = f"docforge_{uuid.uuid4().hex}"
            schema = INDEX if name == "index" else FACTS
            columns = ", ".join(f"`{c.strip().split(' ', 1)[0]}` {c.strip().split(' ', 1)[1]}" for c in schema.split(","))
            location = os.path.join(self.path, name).replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (url) SORTED BY (url) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{location}'")
            self._tables[name] = table
        return self.spark.table(self._tables[name])

    def close(self) -> None:
        """Take the tables out of the catalog; their files stay."""
        for table in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()

    def bucket_files(self, name: str) -> dict[int, list[str]]:
        if name not in self._files:
            fs, hpath = _fs(self.spark, os.path.join(self.path, name))
            found: dict[int, list[str]] = {}
            for status in fs.listStatus(hpath):
                path = status.getPath().toString()
                if path.endswith(".parquet"):
                    found.setdefault(int(BUCKET_FILE.search(os.path.basename(path))[1]), []).append(path)
            self._files[name] = found
        return self._files[name]

    def _join(self, urls: DataFrame, name: str, columns: list[str], few: list[int] | None) -> DataFrame | None:
        """Rows of ``urls`` that the table has, with ``columns`` of it; None if no bucket has any."""
        schema = INDEX if name == "index" else FACTS
        if few is None:
            return self.table(name).select("url", *columns).join(urls, "url")
        files = [f for k in few for f in self.bucket_files(name).get(k, [])]
        if not files:
            return None
        return self.spark.read.schema(schema).parquet(*files).select("url", *columns).join(F.broadcast(urls), "url")

    def _hit(self, urls: DataFrame) -> list[int] | None:
        """Buckets of a few URLs, at most half as many as buckets; None for more."""
        at = F.pmod(F.hash("url"), F.lit(self.buckets))
        row = urls.where("url IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.collect_set(at).alias("k")).first()
        return sorted(row.k) if row.n <= self.buckets // 2 else None

    def fetch(self, urls: DataFrame, columns: list[str]) -> DataFrame:
        """``urls`` (a written table with distinct url) that have a reduced page, with ``columns`` of it."""
        few = self._hit(urls)
        found = [self._join(urls, f"run={k}", columns, few) for k in range(len(self.runs))]
        found = [f for f in found if f is not None]
        if not found:
            types = {f.name: f for f in T._parse_datatype_string(FACTS).fields}
            return self.spark.createDataFrame([], T.StructType([
                types["url"], *[types[c] for c in columns],
                *[f for f in urls.schema.fields if f.name != "url"]]))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.withColumn("page_id", F.nullif("page_id", F.lit(LAST))) if "page_id" in columns else out

    # ---- reducing pages

    def _commit_run(self, rows: DataFrame) -> None:
        name = f"run={len(self.runs)}"
        self._write(rows, name, FACTS)
        n = self.table(name).count()
        _write_text(self.spark, os.path.join(self.path, name, MARKER), json.dumps({"pages": n}))
        self.runs.append(n)

    def reduce_all(self) -> None:
        """One run of all first pages that no run has."""
        if sum(self.runs) >= self.n_urls:
            return
        done = [self.table(f"run={k}").select("url") for k in range(len(self.runs))]
        if not done and self.n_rows == self.n_urls:     # no URL repeats: all pages are first pages
            return self._commit_run(self._rows(self.pages.where("url IS NOT NULL"), self.p))
        wanted = self.table("index")
        for d in done:
            wanted = wanted.join(d, "url", "left_anti")
        wanted = materialise(wanted, "wanted-pages")
        # on the pair, so that a URL that many pages have is not one hot key
        rows = self._rows(self.pages, self.p).join(wanted, ["url", "page_id"], "left_semi")
        self._commit_run(rows.dropDuplicates(["url", "page_id"]))

    def reduce_some(self, urls: DataFrame) -> None:
        """One run of the pages of ``urls`` (a written table, at most ``FEW``) that no run has."""
        have = materialise(self.fetch(urls.select("url"), []).select("url"), "reduced-already")
        new = materialise(urls.select("url").join(have, "url", "left_anti"), "wanted-urls")
        found = self._join(new, "index", ["page_id"], self._hit(new))
        if found is None or (wanted := materialise(found, "wanted-pages")).isEmpty():
            return
        pages = self.pages.join(F.broadcast(wanted), ["url", "page_id"], "left_semi")
        self._commit_run(self._rows(pages, self.p).dropDuplicates(["url", "page_id"]))
