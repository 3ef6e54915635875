"""Global order statistics without a single-partition window.

``running_sum`` gives every row its prefix sum in a total order, the
distributed way: range-partition on the order key, sort within partitions,
sum rows inside each partition, then add per-partition offsets computed from a table with one row per partition (its
size is bounded by the partition count, so broadcasting it is safe).  The
numbered data is written to the shared checkpoint folder before the offsets
are taken, so a re-executed task can never renumber rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def _n_parts(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    sc = df.sparkSession.sparkContext
    return max(sc.defaultParallelism, df.rdd.getNumPartitions())


def running_sum(df: DataFrame, order_cols: list[str], value_col: str,
                out_col: str = "cum", partitions: int | None = None) -> DataFrame:
    """Adds ``out_col`` = inclusive prefix sum of ``value_col`` (bigint) in
    ``order_cols`` order.  Meant for narrow tables (keys + value): the
    in-partition sum runs in an Arrow-batched ``mapInPandas``."""
    n = _n_parts(df, partitions)
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    fields = ranged.schema.fields + [T.StructField("_pid", T.IntegerType()),
                                     T.StructField("_local", T.LongType())]
    schema = T.StructType(fields)

    def local_cumsum(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry = 0
        for pdf in batches:
            vals = pdf[value_col].fillna(0).astype("int64")
            cs = vals.cumsum() + carry
            if len(cs):
                carry = int(cs.iloc[-1])
            pdf = pdf.assign(_pid=pd.Series([pid] * len(pdf), dtype="int32"),
                             _local=cs.astype("int64"))
            yield pdf

    tagged = cut_lineage(ranged.mapInPandas(local_cumsum, schema))
    totals = tagged.groupBy("_pid").agg(F.max("_local").alias("_tot"))
    offsets = totals.select(
        "_pid", (F.sum("_tot").over(Window.orderBy("_pid")) - F.col("_tot")).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_pid", "_local", "_off"))
