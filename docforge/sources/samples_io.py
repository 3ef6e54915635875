"""Sample sink S3 / sample scan S4 / JSON codec X15.

Samples are JSON lines with exactly three string fields.  Equality is
defined on parsed rows, never on bytes (Spark writes raw UTF-8, no spaces).
The scan uses an explicit schema (no inference pass) in PERMISSIVE mode and
keeps unparsable lines in ``_corrupt``.

Batches of a stream are appended exactly once: each writes its files to a folder of its
own, and a small manifest, written aside and renamed, makes them visible.  A batch that is
killed after its files has no manifest and gives no line; one that is run again names its new
folder in the same manifest, and the old files give no line any more.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .state import _fs, _read_text, _write_text

SAMPLE = T.StructType([
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])
SAMPLE_WITH_CORRUPT = T.StructType(SAMPLE.fields + [T.StructField("_corrupt", T.StringType())])


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """S3: append one JSON object per sample."""
    samples.select("instruction", "input", "output").write.mode(mode).json(path)


def read_samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSONL -> (instruction, input, output, _corrupt)."""
    return (spark.read.schema(SAMPLE_WITH_CORRUPT)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt")
            .json(path))


def append_batch(samples: DataFrame, path: str, batch: int) -> None:
    """S3 of a stream: the samples of one batch, visible once its manifest is committed."""
    folder = f"batch-{batch}-{uuid.uuid4().hex[:8]}"
    write_samples(samples, os.path.join(path, folder), "errorifexists")
    _write_text(samples.sparkSession, os.path.join(path, "_manifest", f"{batch}.json"), json.dumps({"folder": folder}))


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """S4 of a stream: the lines of committed batches, (instruction, input, output, _corrupt)."""
    fs, hpath = _fs(spark, os.path.join(path, "_manifest"))
    names = [s.getPath().toString() for s in fs.listStatus(hpath)] if fs.exists(hpath) else []
    folders = [json.loads(_read_text(spark, n))["folder"] for n in names if n.endswith(".json")]
    if not folders:
        return spark.createDataFrame([], SAMPLE_WITH_CORRUPT)
    return read_samples(spark, [os.path.join(path, f) for f in sorted(folders)])


def to_json_line(samples: DataFrame) -> DataFrame:
    """X15 encode: adds ``line``."""
    return samples.withColumn("line", F.to_json(F.struct("instruction", "input", "output")))
