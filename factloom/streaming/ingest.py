"""Incremental ingest: once-only appends, a resumable ledger, a session buffer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_new_files(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """A stream of the files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def append_once(stream: DataFrame, target: str, checkpoint: str, id_col: str) -> StreamingQuery:
    """Appends rows whose id is not in the target yet; a batch that is run again adds nothing.

    Every micro-batch lands in a folder of its own number, which a rerun overwrites.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([id_col])
        try:
            known = spark.read.option("recursiveFileLookup", "true").parquet(target)
        except Exception as e:  # noqa: BLE001 - an absent or empty target has no rows yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        if known is not None:
            known = known.where(~F.input_file_name().contains(f"/batch={number}/"))
            new = new.join(known.select(id_col), id_col, "left_anti")
        new.write.mode("overwrite").parquet(str(PurePath(target) / f"batch={number}") if "://" not in target else f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_with_ledger(chunks: DataFrame, ledger: DataFrame | None, process: Callable[[DataFrame], DataFrame], retry_errors: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, ledger rows) of the chunks that the ledger lacks.

    The ledger has (custom_id, n): n results, 0 none, -1 an error; with
    ``retry_errors`` the latter count as missing.
    """
    todo = chunks
    if ledger is not None:
        done = ledger.where("n >= 0") if retry_errors else ledger
        todo = chunks.join(done.select("custom_id"), "custom_id", "left_anti")
    results = process(todo)
    counts = results.groupBy("custom_id").agg(F.count("*").alias("n"))
    return results, todo.select("custom_id").distinct().join(counts, "custom_id", "left").select("custom_id", F.coalesce("n", F.lit(0)).alias("n"))


def session_buffer(stream: DataFrame, key: str, value: str, most: int = 10, idle: str = "30 minutes") -> DataFrame:
    """(key, buffer, n_seen): the last ``most`` values of each session, kept in state until it idles."""
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        buffer, seen = state.get if state.exists else ([], 0)
        buffer = list(buffer)
        for f in frames:
            buffer = (buffer + f[value].astype(str).tolist())[-most:]
            seen += len(f)
        state.update((buffer, seen))
        state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame({key: [k[0]], "buffer": [buffer], "n_seen": [seen]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, buffer array<string>, n_seen long", "buffer array<string>, n_seen long", "update", GroupStateTimeout.ProcessingTimeTimeout)
