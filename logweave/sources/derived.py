"""An operation log derived from an event table: views and clicks append entries, errors compact, purchases put keys,
sign-ups clean a region or delete a key. It is the engine's test log and its benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE_ROWS = 100


def log_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queue, file_seq, lsn, region_id, kind, first_index, last_index, key, value."""
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def from_events(events: DataFrame) -> DataFrame:
    upto = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(F.when(F.col("event_type").isin("view", "click"), 1)).over(upto)
    e = events.select("event_id", "user_id", "event_type", "props", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"), n.alias("n"))
    kind = F.when(F.col("event_type").isin("view", "click"), "ENTRIES").when(F.col("event_type") == "purchase", "PUT").when(F.col("event_type") == "error", "COMPACT").when(F.col("k") < 2, "CLEAN").otherwise("DEL")
    e = e.withColumn("kind", kind)
    return e.select(
        F.lit(0).cast("tinyint").alias("queue"),
        (F.lit(1) + F.floor(F.col("event_id") / FILE_ROWS)).cast("long").alias("file_seq"),
        F.col("event_id").alias("lsn"),
        F.col("user_id").alias("region_id"),
        "kind",
        F.when(F.col("kind") == "ENTRIES", 3 * F.col("n") - F.col("k") % 3).when(F.col("kind") == "COMPACT", F.greatest(F.lit(0), 3 * F.col("n") - F.col("k") % 30)).alias("first_index"),
        F.when(F.col("kind") == "ENTRIES", 3 * F.col("n") + 2).alias("last_index"),
        F.when(F.col("kind").isin("PUT", "DEL"), F.concat(F.lit("k"), (F.col("k") % 10).cast("string"))).cast("binary").alias("key"),
        F.when(F.col("kind") == "PUT", F.col("props")).cast("binary").alias("value"),
    )


def with_holes(items: DataFrame, every: int = 17) -> DataFrame:
    """The log without every ``every``-th ENTRIES row (by lsn)."""
    return items.where((F.col("kind") != "ENTRIES") | (F.col("lsn") % every != 0))


def entry_size(region_id: str = "region_id", index: str = "index"):
    """The length that test entries have: between 16 and 79 bytes, by region and index."""
    return F.lit(16) + F.pmod(F.col(region_id) * 31 + F.col(index) * 7, F.lit(64))


def two_queues(items: DataFrame, gate: int) -> tuple[DataFrame, DataFrame]:
    """(rewrite, append): all that was live at the end of file ``gate`` rewritten, and the append files from four fifths of it on."""
    from ..operators.fold import live_kvs, live_runs

    old = items.where(F.col("file_seq") <= gate)
    seq = (F.lit(1) + F.floor(F.col("file_seq") / 10)).cast("long").alias("file_seq")
    queue = F.lit(1).cast("tinyint").alias("queue")
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    entries = live_runs(old).select(queue, seq, "lsn", "region_id", F.lit("ENTRIES").alias("kind"), F.col("lo").alias("first_index"), F.col("hi").alias("last_index"), none("binary", "key"), none("binary", "value"))
    puts = live_kvs(old).select(queue, seq, "lsn", "region_id", F.lit("PUT").alias("kind"), none("long", "first_index"), none("long", "last_index"), "key", "value")
    return entries.unionByName(puts), items.where(F.col("file_seq") > gate * 4 // 5)
