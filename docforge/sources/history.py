"""Key histories: what earlier batches or steps have seen, as runs of rows by key hash.

A batch asks which of its keys may be in the history.  Reading all of it each time would
be quadratic over a run, so:

* Each batch appends one *run*: its distinct keys, in Parquet parts by key hash, and a Bloom
  filter for each part (bitmaps of 32,768 bits, made by Spark's bitmap aggregate).
* A question sends the hashes of the batch's keys to the filters, by run and part, and
  reads only parts of which a filter holds one of them.
* A history of few rows (``OPEN_ALL``) is read as it is.
* Runs of like size are merged when there are ``FAN`` of them, so their number grows with
  the logarithm of the batches.

The runs that count are listed by a manifest, one small file a generation, written aside
and renamed.  A writer that is killed, merging or not, leaves folders that no manifest
names.  A batch that is run again replaces its own run.  Merged runs are deleted by the next
merge, so that frames which still read them can end.

Keys may be null and repeat.  A run without rows is not written.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .state import _fs, _read_text, _write_text

#: runs of one size class that are merged, and the factor between classes
FAN, SMALLEST = 8, 1000
#: rows in a part; bits a row in the filter, positions a row; bits in a bitmap
PART_ROWS, BITS, POSITIONS, BITMAP = 1_000_000, 10, 3, 32_768
#: rows up to which asking the filters costs more than reading everything
OPEN_ALL = 20_000
LOW32 = (1 << 32) - 1


def _power_of_two(n: int) -> int:
    return 1 << max(0, (max(1, n) - 1).bit_length())


class KeyHistory:
    """Rows of the key columns ``schema`` (DDL) by batch number."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.columns = T._parse_datatype_string(schema).fieldNames()
        #: (run, part) that the last question opened
        self.opened: list[tuple[str, int]] = []

    # ---- manifest

    def _generation(self) -> tuple[int, dict]:
        fs, hpath = _fs(self.spark, os.path.join(self.path, "manifest"))
        names = [s.getPath().getName() for s in fs.listStatus(hpath)] if fs.exists(hpath) else []
        for n in sorted((int(x[4:-5]) for x in names if x.startswith("gen=") and x.endswith(".json")), reverse=True):
            try:
                return n, json.loads(_read_text(self.spark, os.path.join(self.path, "manifest", f"gen={n}.json")))
            except (TypeError, ValueError):     # unreadable: the one before counts
                continue
        return 0, {"runs": [], "retired": []}

    def runs(self) -> list[dict]:
        """{name, first, last, rows, parts} of the committed runs."""
        return self._generation()[1]["runs"]

    def _commit(self, generation: int, runs: list[dict], retired: list[str]) -> None:
        _write_text(self.spark, os.path.join(self.path, "manifest", f"gen={generation}.json"),
                    json.dumps({"runs": runs, "retired": retired}))

    def _delete(self, name: str) -> None:
        fs, hpath = _fs(self.spark, os.path.join(self.path, name))
        fs.delete(hpath, True)

    # ---- writing

    def _hash(self) -> Column:
        return F.xxhash64(*self.columns)

    def _write_run(self, rows: DataFrame, first: int, last: int, n: int | None = None) -> dict | None:
        """``n``: number of rows, where the caller knows it and they are distinct."""
        rows = rows.select(*self.columns)
        if n is None:
            rows = materialise(rows.distinct(), "history-rows")
            n = rows.count()
        if not n:
            return None
        name, parts = f"run-{first}-{last}-{uuid.uuid4().hex[:8]}", _power_of_two(-(-n // PART_ROWS))
        at = os.path.join(self.path, name)
        part = F.pmod(F.col("_h"), F.lit(parts)).cast("int").alias("_part")
        (rows.withColumn("_h", self._hash()).select("*", part)
         .repartition("_part").sortWithinPartitions("_part", "_h")
         .write.partitionBy("_part").parquet(os.path.join(at, "rows")))
        hashed = self.spark.read.schema("_h long, _part int").parquet(os.path.join(at, "rows"))
        bits = BITMAP * _power_of_two(-(-n * BITS // (parts * BITMAP)))
        low, high = F.col("_h").bitwiseAND(LOW32), F.shiftrightunsigned("_h", 32)
        spots = hashed.select("_part", F.explode(F.array(*[
            (low + high * k).bitwiseAND(bits - 1) for k in range(1, POSITIONS + 1)])).alias("_at"))
        (spots.groupBy("_part", F.floor(F.col("_at") / BITMAP).cast("int").alias("bucket"))
         .agg(F.bitmap_construct_agg(F.col("_at") % BITMAP).alias("bits"))
         .write.parquet(os.path.join(at, "filter")))
        return {"name": name, "first": first, "last": last, "rows": n, "parts": parts, "bits": bits}

    def write(self, batch: int, rows: DataFrame, n: int | None = None) -> None:
        """Append the keys of a batch; a batch that is run again replaces its own.  ``n``: their
        number, if it is known and they are distinct."""
        generation, found = self._generation()
        mixed = [r for r in found["runs"] if r["first"] < batch <= r["last"]]
        if mixed:
            raise ValueError(f"batch {batch} is part of a merged run; only the last batch can be run again")
        runs = [r for r in found["runs"] if r["last"] < batch]
        gone = [r["name"] for r in found["runs"] if r["last"] >= batch]
        generation, retired = self._merge(generation, runs, found["retired"])
        new = self._write_run(rows, batch, batch, n)
        self._commit(generation + 1, runs + ([new] if new else []), retired + gone)

    def _merge(self, generation: int, runs: list[dict], retired: list[str]) -> tuple[int, list[str]]:
        """Merge the smallest size class that is full; changes ``runs``."""
        classes: dict[int, list[dict]] = {}
        for r in runs:
            size = 0
            while r["rows"] > SMALLEST * FAN ** size:
                size += 1
            classes.setdefault(size, []).append(r)
        full = next((c for _, c in sorted(classes.items()) if len(c) >= FAN), None)
        if not full:
            return generation, retired
        rows = self._read([self._parts_of(r["name"]) for r in full])
        merged = self._write_run(rows, min(r["first"] for r in full), max(r["last"] for r in full))
        for name in retired:        # merged an earlier time
            self._delete(name)
        runs[:] = [r for r in runs if r not in full] + [merged]
        retired = [r["name"] for r in full]
        self._commit(generation + 1, runs, retired)
        return generation + 1, retired

    # ---- reading

    def _parts_of(self, name: str) -> str:
        return os.path.join(self.path, name, "rows", "_part=*")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rows(self, before: int) -> DataFrame:
        """All keys of batches before ``before``; a key may come more than once."""
        return self._read([self._parts_of(r["name"]) for r in self.runs() if r["last"] < before])

    def may_match(self, keys: DataFrame, before: int) -> DataFrame:
        """Keys of batches before ``before``, at least all that equal one of ``keys``: the
        rows of the parts whose filter holds one of them."""
        runs = [r for r in self.runs() if r["last"] < before]
        self.opened = []
        if sum(r["rows"] for r in runs) <= OPEN_ALL:
            return self._read([self._parts_of(r["name"]) for r in runs])
        if runs:
            self.opened = [(runs[r.run]["name"], r["_part"]) for r in self._hits(keys, runs).collect()]
        return self._read([os.path.join(self.path, name, "rows", f"_part={part}") for name, part in self.opened])

    def _hits(self, keys: DataFrame, runs: list[dict]) -> DataFrame:
        """(run, _part) whose filter holds a key; at most one row for each part of a run."""
        known = F.array(*[F.struct(F.lit(k).alias("run"), F.lit(r["parts"]).alias("parts")) for k, r in enumerate(runs)])
        asked = keys.select(self._hash().alias("_h")).distinct().select("_h", F.explode(known).alias("_r")).select(
            F.col("_r.run").alias("run"), F.pmod(F.col("_h"), F.col("_r.parts")).cast("int").alias("_part"), "_h")
        schema = "_part int, bucket int, bits binary"
        filters = None
        for k, r in enumerate(runs):
            one = self.spark.read.schema(schema).parquet(os.path.join(self.path, r["name"], "filter")).select(
                F.lit(k).alias("run"), "*")
            filters = one if filters is None else filters.unionByName(one)
        sizes = [r["bits"] for r in runs]
        positions, bitmap = POSITIONS, BITMAP

        def held(asked, filters):
            import numpy as np
            import pyarrow as pa
            empty = pa.table([pa.array([], pa.int32()), pa.array([], pa.int32())], ["run", "_part"])
            if not asked.num_rows or not filters.num_rows:
                return empty
            run, part = asked.column("run")[0].as_py(), asked.column("_part")[0].as_py()
            bits = np.zeros(sizes[run] // 8, np.uint8)
            for bucket, data in zip(filters.column("bucket").to_pylist(), filters.column("bits").to_pylist()):
                bits[bucket * bitmap // 8:][:len(data)] = np.frombuffer(data, np.uint8)
            h = asked.column("_h").to_numpy().view(np.uint64)
            low, high, good = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32), np.ones(len(h), bool)
            for k in range(1, positions + 1):
                at = (low + high * np.uint64(k)) & np.uint64(sizes[run] - 1)
                good &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            if not good.any():
                return empty
            return pa.table([pa.array([run], pa.int32()), pa.array([part], pa.int32())], ["run", "_part"])

        return asked.groupBy("run", "_part").cogroup(filters.groupBy("run", "_part")).applyInArrow(
            held, "run int, _part int")
