"""Session helpers: a local session for tests/bench and the shared checkpoint
folder used to cut lineage in iterative stages."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "docforge") -> SparkSession:
    """Session for tests and the local bench (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared, fault-tolerant folder and is
    always used as is.  Where it is unset, a folder is made only for a local
    master (tests, bench); elsewhere that would be a machine-local folder, so
    it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="docforge-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


#: scratch folders that go when the driver's JVM ends
_SWEPT: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables.  All of an
    application's lie in one folder, which its file system deletes when the driver ends."""
    sc = spark.sparkContext
    base = os.path.join(ensure_checkpoint_dir(spark), f"scratch-{sc.applicationId}")
    if base not in _SWEPT:
        hpath = sc._jvm.org.apache.hadoop.fs.Path(base)
        fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(hpath)
        fs.deleteOnExit(hpath)
        _SWEPT.add(base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.  Unlike a
    checkpoint the result is a plain scan: a join of two such tables has two
    plain shuffles below it, and AQE can split a key that is hot on one side."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (works for
    any cluster file system, no read attempted)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, min_tasks: int | None = None) -> DataFrame:
    """Make sure CPU-heavy per-row stages get at least one task per core.

    A scan of many row groups is already parallel and is left alone (no
    shuffle).  A scan with fewer splits than cores (e.g. a single row group)
    is spread round-robin once, before the expensive per-row work."""
    sc = df.sparkSession.sparkContext
    want = min_tasks or 3 * sc.defaultParallelism   # several per core: row sizes vary
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)
