"""A session with the engine's settings; a cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(name: str = "factloom", cpus: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if cpus or "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cpus or 8}]").config("spark.sql.shuffle.partitions", str(cpus or 8))
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
