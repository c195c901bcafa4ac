"""State of regions and files, sizes, counters and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket
from .fold import CHUNK


def region_state(items_regions: DataFrame, runs: DataFrame, kvs: DataFrame) -> DataFrame:
    """One row for each region: index span, counts, rewritten counts and the oldest files it needs in each queue."""
    of_queue = lambda c, q: F.when(F.col("queue") == q, F.col(c))
    e = runs.groupBy("region_id").agg(
        F.min("lo").alias("first_index"), F.max("hi").alias("last_index"), F.sum(F.col("hi") - F.col("lo") + 1).alias("entry_count"),
        F.sum(F.when(F.col("queue") == 1, F.col("hi") - F.col("lo") + 1).otherwise(0)).alias("rewrite_count"),
        F.min(of_queue("file_seq", 0)).alias("e0"), F.min(of_queue("file_seq", 1)).alias("e1"),
    )
    k = kvs.groupBy("region_id").agg(F.count("*").alias("kv_count"), F.min(of_queue("file_seq", 0)).alias("k0"), F.min(of_queue("file_seq", 1)).alias("k1"))
    joined = items_regions.select("region_id").join(e, "region_id", "left").join(k, "region_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("region_id", "first_index", "last_index", zero("entry_count"), zero("rewrite_count"), zero("kv_count"), F.least("e0", "k0").alias("min_append_seq"), F.least("e1", "k1").alias("min_rewrite_seq"))


def pin_atomic_groups(state: DataFrame, groups: DataFrame) -> DataFrame:
    """A region whose oldest rewritten file lies in a live atomic group (region_id, start_seq, end_seq) needs the group's start."""
    joined = state.join(groups, "region_id", "left")
    pinned = F.when(F.col("min_rewrite_seq") <= F.col("end_seq"), F.least("min_rewrite_seq", "start_seq")).otherwise(F.col("min_rewrite_seq"))
    return joined.withColumn("min_rewrite_seq", pinned).drop("start_seq", "end_seq")


def file_liveness(items: DataFrame, runs: DataFrame, kvs: DataFrame) -> DataFrame:
    """queue, file_seq, item_count, live_entries, live_kvs of each file."""
    a = items.groupBy("queue", "file_seq").agg(F.count("*").alias("item_count"))
    e = runs.groupBy("queue", "file_seq").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("live_entries"))
    k = kvs.groupBy("queue", "file_seq").agg(F.count("*").alias("live_kvs"))
    joined = a.join(e, ["queue", "file_seq"], "left").join(k, ["queue", "file_seq"], "left")
    return joined.select("queue", "file_seq", "item_count", F.coalesce("live_entries", F.lit(0)).alias("live_entries"), F.coalesce("live_kvs", F.lit(0)).alias("live_kvs"))


def file_span(items: DataFrame) -> DataFrame:
    """queue, first_seq, active_seq."""
    return items.groupBy("queue").agg(F.min("file_seq").alias("first_seq"), F.max("file_seq").alias("active_seq"))


def total_size(span: DataFrame, target_file_size: int) -> DataFrame:
    """Size of each queue as whole files of the target size."""
    return span.select("queue", ((F.col("active_seq") - F.col("first_seq") + 1) * F.lit(target_file_size)).alias("total_size"))


def used_size(span: DataFrame, target_file_size: int) -> DataFrame:
    return total_size(span, target_file_size).agg(F.sum("total_size").alias("used_size"))


def file_at(span: DataFrame, position: float) -> DataFrame:
    """The file at a relative position (clamped to 0..1) of each queue."""
    p = min(max(position, 0.0), 1.0)
    return span.select("queue", (F.col("first_seq") + F.floor((F.col("active_seq") - F.col("first_seq") + 1) * F.lit(p)).cast("long")).alias("file_seq"))


def file_references(items: DataFrame, applied: DataFrame) -> DataFrame:
    """queue, file_seq, pending of files with operations that no reader has applied yet; ``applied`` has queue and lsn (up to which)."""
    counted = items.join(F.broadcast(applied.select("queue", F.col("lsn").alias("_applied"))), "queue", "left")  # a row a queue
    open_ = counted.where("_applied IS NULL OR lsn > _applied")
    return open_.groupBy("queue", "file_seq").agg(F.count("*").alias("pending"))


def live_counts(runs: DataFrame, kvs: DataFrame) -> DataFrame:
    """Live entries and key-values of each queue, as one number."""
    both = runs.select("queue", (F.col("hi") - F.col("lo") + 1).alias("n")).unionByName(kvs.select("queue", F.lit(1).cast("long").alias("n")))
    return both.groupBy("queue").agg(F.sum("n").alias("live_count"))


def garbage_ratio(items: DataFrame, runs: DataFrame, kvs: DataFrame) -> DataFrame:
    """written, deleted and their ratio for the rewrite queue; 0 / 0 is no garbage."""
    size = F.when(F.col("kind") == "ENTRIES", F.col("last_index") - F.col("first_index") + 1).when(F.col("kind") == "PUT", F.lit(1)).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    written = items.where("queue = 1").select(size.cast("long").alias("w"), zero.alias("l"))
    live = live_counts(runs, kvs).where("queue = 1").select(zero.alias("w"), F.col("live_count").alias("l"))
    total = written.unionByName(live).agg(F.coalesce(F.sum("w"), zero).alias("written"), F.coalesce(F.sum("l"), zero).alias("live"))
    deleted = F.col("written") - F.col("live")
    return total.select("written", deleted.alias("deleted"), F.coalesce(F.try_divide(deleted, F.col("written")), F.lit(0.0)).alias("ratio"))


def nth_entry_seq(runs: DataFrame, n: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """file_seq of the n-th live entry (in index order) of each region; ``n`` has region_id and n. No run is exploded.

    Runs are counted in chunks of ``chunk`` indexes, so that a region of any size is many tasks' work.
    """
    by = ["region_id", "chunk"]
    size = F.col("hi") - F.col("lo") + 1
    cut = runs.select("region_id", "lo", "file_seq", size.alias("size"), F.floor(F.col("lo") / F.lit(chunk)).cast("long").alias("chunk")).repartition(*by)
    earlier = lambda w, order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by).agg(F.sum("size").alias("n_chunk"))
    offset = sums.select(*by, F.coalesce(F.sum("n_chunk").over(earlier(Window.partitionBy("region_id"), "chunk")), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("size").over(earlier(Window.partitionBy(*by), "lo")), F.lit(0))
    counted = cut.withColumn("inside", inside).join(offset, by).select("region_id", "file_seq", (F.col("offset") + F.col("inside")).alias("before"), "size")
    return n.join(counted, "region_id").where("n > before AND n <= before + size").select("region_id", "n", "file_seq")


def memory_usage(state: DataFrame, entry_bytes: int = 40) -> DataFrame:
    """Bytes of the index of each region, at a fixed size an entry."""
    return state.select("region_id", (F.col("entry_count") * F.lit(entry_bytes)).alias("bytes"))


def histogram(df: DataFrame, value: str, start: float, factor: float, count: int) -> DataFrame:
    """bucket and n of an exponential histogram of ``value``."""
    return df.groupBy(bucket(F.col(value), start, factor, count).alias("bucket")).agg(F.count("*").alias("n"))


def latency_summary(df: DataFrame, value: str) -> DataFrame:
    """Count, min, avg, exact percentiles and max of ``value``, as a load test reports them."""
    p = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    return df.agg(F.count("*").alias("n"), F.min(value).alias("min"), F.avg(value).alias("avg"), *(F.percentile(value, q).alias(k) for k, q in p.items()), F.max(value).alias("max"))


def fairness(df: DataFrame, by: str) -> DataFrame:
    """Spread of the operations of each worker: sample deviation over median."""
    return df.groupBy(by).agg(F.count("*").alias("n")).agg((F.stddev_samp("n") / F.percentile("n", 0.5)).alias("fairness"))


def write_bandwidth(items: DataFrame, size: str, seconds: str) -> DataFrame:
    """Bytes written, seconds from first to last, and their ratio, for each queue."""
    g = items.groupBy("queue").agg(F.sum(size).alias("bytes"), (F.max(seconds) - F.min(seconds)).cast("double").alias("seconds"))
    return g.select("queue", "bytes", "seconds", F.try_divide("bytes", "seconds").alias("bytes_per_second"))
