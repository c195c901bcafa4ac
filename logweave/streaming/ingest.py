"""Streaming ingest: append operations to the log table, and keep each region's live runs as state.

The input must come in order of lsn within a region (across micro-batches); an operation older than
what was applied stops the stream, it is never silently re-ordered.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import InvalidArgument
from ..session import scratch

OUTPUT = "region_id long, first_index long, last_index long, entry_count long, lsn long"
STATE = "runs string, lsn long"
#: Steps in which the derived log is streamed.
STEPS = 4


def apply_operation(runs: deque[list[int]], kind: str, first: int, last: int) -> None:
    """One more operation on live runs, in place: appends cut what they overwrite, compactions raise the floor.

    Runs lie in order, so that only those that go are looked at, and one besides.
    """
    if kind == "CLEAN":
        runs.clear()
    elif kind == "ENTRIES":
        while runs and runs[-1][0] >= first:
            runs.pop()
        if runs:
            runs[-1][1] = min(runs[-1][1], first - 1)
        runs.append([first, last])
    elif kind == "COMPACT":
        while runs and runs[0][1] < first:
            runs.popleft()
        if runs:
            runs[0][0] = max(runs[0][0], first)


def fold_region(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    runs, seen = (deque(json.loads(state.get[0])), state.get[1]) if state.exists else (deque(), -1)
    rows = sorted((r for b in batches for r in zip(*(b[c].tolist() for c in ("lsn", "kind", "first_index", "last_index")), strict=True)), key=itemgetter(0))
    for lsn, kind, first, last in rows:
        if lsn <= seen:
            raise InvalidArgument(f"operation {lsn} of region {key[0]} comes after {seen}")
        seen = lsn
        apply_operation(runs, kind, first, last)
    state.update((json.dumps(list(runs)), seen))
    count = sum(b - a + 1 for a, b in runs)
    yield pd.DataFrame({"region_id": [key[0]], "first_index": [runs[0][0] if runs else -1], "last_index": [runs[-1][1] if runs else -1], "entry_count": [count], "lsn": [seen]})


def live_state(items: DataFrame) -> DataFrame:
    """A stream of each touched region's state (region_id, first_index, last_index, entry_count; -1 where it has none)."""
    index = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)  # noqa: E731  pandas makes floats of columns with nulls
    narrow = items.select("region_id", "lsn", "kind", index("first_index"), index("last_index"))
    return narrow.groupBy("region_id").applyInPandasWithState(fold_region, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def append_log(items: DataFrame, path: str, checkpoint: str):
    """Append a stream of operations to the log table at ``path``; each micro-batch is one atomic write."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").partitionBy("queue", "file_seq").parquet(path)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last index of each region, from a stream over the derived log in ``STEPS`` ordered steps.

    The log is derived once, by all tasks. The stream takes up each step's files, however many, in one micro-batch and
    stops; the next step's are written after that, and it goes on from its checkpoint.
    """
    from ..sources import derived

    root = scratch(spark, "stream")
    items = derived.log_items(spark, sf_dir).select("region_id", "lsn", "file_seq", "kind", "first_index", "last_index")
    last = items.agg(F.max("file_seq")).first()[0] or 1
    step = sum((F.col("file_seq") > last * i // STEPS).cast("int") for i in range(1, STEPS))
    stepped = items.withColumn("step", step)
    stepped.write.partitionBy("step").parquet(f"{root}/log")
    log = spark.read.schema(stepped.schema).parquet(f"{root}/log")
    spark.createDataFrame([], OUTPUT).write.parquet(f"{root}/out")
    for i in range(STEPS):
        log.where(F.col("step") == i).drop("step").write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(items.schema).parquet(f"{root}/in")
        run = live_state(source).writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    latest = spark.read.schema(OUTPUT).parquet(f"{root}/out").groupBy("region_id").agg(F.max_by(F.struct("first_index", "last_index", "entry_count"), "lsn").alias("s"))
    return latest.where("s.entry_count > 0").select("region_id", "s.first_index", "s.last_index")
