"""Total row numbers that scale, and ranking of retrieved facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.durable import durable


def global_row_number(df: DataFrame, order: Sequence[Column], out: str = "row") -> DataFrame:
    """Row numbers from 1 in a total order, by range partitions and their offsets.

    A window without a partition key would sort everything in one task.  Here
    the sorted partitions number their own rows, and one offset per partition
    goes through the driver.  The sorted rows are kept: a second sort could cut
    the partitions elsewhere, as adaptive plans do when columns are pruned.
    """
    ordered = durable(df.orderBy(*order).withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = {r["__pid"]: r["n"] for r in ordered.groupBy("__pid").agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, 0
    for pid in sorted(counts):
        offsets[pid], total = total, total + counts[pid]
    if not offsets:
        return df.withColumn(out, F.lit(None).cast("long"))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("__pid"))
    return ordered.withColumn(out, (start + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).cast(T.LongType())).drop("__pid", "__at")
