"""S5 state_save / S6 state_load: the crawl's state as append-only tables.

Every step of a run writes its own folder ``step=N`` below the state directory:
``log`` (visited URLs with their decisions), ``samples``, ``frontier`` (the queue after
the step).  Beside them lie two key histories by step (history.py): ``visited`` URLs and
the ``buckets`` of kept documents, the dedup index.  A small marker file, written under another name and renamed, commits the step.  The state
is the union of the committed steps and the last one's frontier; a step without
marker is not part of it and is overwritten by the next run.  An unreadable
marker ends the committed steps there: a state is complete or absent, never half.
"""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

log = logging.getLogger(__name__)
MARKER = "_COMMITTED.json"

TABLES = {
    "log": "url string, depth int, crawl_key array<bigint>, page_id long, gate_reason string, "
           "n_samples long",
    "samples": "url string, chunk_no long, instruction string, input string, output string",
    "frontier": "url string, depth int, crawl_key array<bigint>",
}


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Readers see the whole file or none: written aside, then renamed."""
    fs, hpath = _fs(spark, path)
    _, aside = _fs(spark, path + ".tmp")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(hpath, False)
    if not fs.rename(aside, hpath):
        raise OSError(f"cannot commit {path}")


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath):
        return None
    scanner = spark.sparkContext._jvm.java.util.Scanner(fs.open(hpath), "UTF-8").useDelimiter("\\A")
    text = scanner.next() if scanner.hasNext() else ""
    scanner.close()
    return text


class CrawlState:
    """The committed steps of a state directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        from .history import KeyHistory
        self.visited = KeyHistory(spark, os.path.join(path, "visited"), "url string")
        self.buckets = KeyHistory(spark, os.path.join(path, "buckets"), "band int, bkey string")
        #: committed steps, samples and URLs so far, smallest depth in the queue (None: empty)
        self.steps, self.collected, self.processed, self.depth = 0, 0, 0, None
        while (meta := self._marker(self.steps)) is not None:
            self.collected, self.processed, self.depth = int(meta["collected_count"]), int(meta["processed"]), meta["depth"]
            self.steps += 1

    def folder(self, step: int, table: str) -> str:
        return os.path.join(self.path, f"step={step}", table)

    def _marker(self, step: int) -> dict | None:
        try:
            text = _read_text(self.spark, self.folder(step, MARKER))
            if text is None:
                return None
            meta = json.loads(text)
            int(meta["collected_count"]), int(meta["processed"]), meta["depth"]
            return meta
        except Exception as e:  # unreadable: the state ends before this step
            log.error("crawl state %s, step %d is unreadable: %s", self.path, step, e)
            return None

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Write a table of the step that is being made and read it back."""
        schema = T._parse_datatype_string(TABLES[table])
        path = self.folder(self.steps, table)
        df.select(*schema.fieldNames()).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def commit(self, collected: int, depth: int | None, processed: int | None = None) -> None:
        """The marker goes last, after all tables of the step.  ``processed`` None: as many
        URLs as before."""
        processed = self.processed if processed is None else processed
        _write_text(self.spark, self.folder(self.steps, MARKER),
                    json.dumps({"collected_count": collected, "processed": processed, "depth": depth}))
        self.collected, self.processed, self.depth = collected, processed, depth
        self.steps += 1

    def read(self, table: str) -> DataFrame:
        """A table over all committed steps."""
        schema = T._parse_datatype_string(TABLES[table])
        paths = [self.folder(k, table) for k in range(self.steps)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def frontier(self) -> DataFrame | None:
        """The queue after the last committed step; None before the first."""
        if not self.steps:
            return None
        schema = T._parse_datatype_string(TABLES["frontier"])
        return self.spark.read.schema(schema).parquet(self.folder(self.steps - 1, "frontier"))
