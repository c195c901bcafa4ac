"""Shared plumbing: document input, scratch tables in the shared folder, crc folds, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch, shared_dir

__all__ = ["SPACE", "SPACE_STR", "HOT", "and_end", "documents", "drop_scratch", "fold", "free_shuffles", "give_back", "join_counted", "materialise", "parallelism", "scratch", "shared_dir", "slices", "utf8"]

#: ASCII white space, as the contracts spell it: space and 0x09 to 0x0D.
SPACE = b" \t\n\x0b\x0c\r"
SPACE_STR = SPACE.decode()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def drop_scratch(spark: SparkSession, df_or_path: DataFrame | str) -> None:
    """Delete a scratch table that no later plan reads."""
    paths = [df_or_path] if isinstance(df_or_path, str) else sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    jvm = spark.sparkContext._jvm
    for p in paths:
        if "/logweave-" in p:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done, which it does once the driver's JVM has collected them.

    With executors, the last plan is still held when the first collection ends, and goes with a later one.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and idle ones would keep it beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more than a share of 1 / HOT of all rows is hot; so there are fewer than HOT hot keys.
HOT = 1000


def join_counted(rows: DataFrame, facts: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of ``facts`` for each key; column ``n`` of facts tells how many of the ``total`` rows have it.

    Facts of hot keys, at most ``HOT`` of them, are sent to their rows, which stay spread out; all others meet by key.
    """
    least = max(HOT, total // HOT + 1)
    names = [c for c in facts.columns if c not in (*on, n)]
    hot = F.broadcast(facts.where(F.col(n) >= least).select(*on, F.struct(*names).alias("_fact")))  # at most HOT rows
    marked = rows.join(hot, on, "left")
    cold = marked.where("_fact IS NULL").drop("_fact").join(facts.where(F.col(n) < least).select(*on, *names), on)
    return marked.where("_fact IS NOT NULL").select(*rows.columns, "_fact.*").unionByName(cold.select(*rows.columns, *names))
