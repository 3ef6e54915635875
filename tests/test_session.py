"""Scratch tables go with the application that wrote them."""
import os
import subprocess
import sys

from tests.conftest import ROOT

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
from docforge.session import materialise
df = materialise(spark.range(3), "table")
import glob
assert df.count() == 3 and glob.glob({shared!r} + "/*/scratch-*/table-*/*.parquet")
"""


def test_scratch_is_deleted_when_the_driver_ends(tmp_path):
    shared = str(tmp_path / "shared")
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, shared=shared)], capture_output=True, text=True,
                          timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert os.path.isdir(shared) and not [d for _, dirs, _ in os.walk(shared) for d in dirs if d.startswith("scratch-")]
