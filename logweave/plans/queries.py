"""The registered queries: each applies operators to the log derived from ``events`` (and never collects it)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import columns as C
from ..functions.hashing import slot
from ..operators import fold, gc, integrity, reads, recover
from ..operators import state as S
from ..session import materialise, scratch
from ..sources import derived, rawlog

CONFIG = EngineConfig(target_file_size=1 << 20, purge_threshold=8 << 20, purge_rewrite_threshold=1 << 20).sanitize()
#: A chunk of the raw files' order keys, which hold a file's number above its places: as many files as have ``fold.CHUNK`` operations.
RAW_CHUNK = fold.CHUNK // derived.FILE_ROWS << rawlog.OFFSET_BITS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


@dataclass
class Log:
    """The derived log and what follows from it: lazy plans, but what several parts of a query read is folded once and kept."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def items(self) -> DataFrame:
        return derived.log_items(self.spark, self.sf_dir)

    @cached_property
    def runs(self) -> DataFrame:
        return fold.live_runs(self.items)

    @cached_property
    def kvs(self) -> DataFrame:
        return fold.live_kvs(self.items)

    @cached_property
    def regions(self) -> DataFrame:
        return fold.regions(self.items)

    @cached_property
    def ends(self) -> DataFrame:
        return reads.first_last(self.runs)

    @cached_property
    def last_file(self) -> int:
        """Number of the newest file: one row of the events' largest id."""
        return 1 + (self.spark.read.parquet(f"{self.sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0) // derived.FILE_ROWS

    @cached_property
    def queues(self) -> tuple[DataFrame, DataFrame]:
        rewrite, append = derived.two_queues(self.items, self.last_file * 9 // 10)
        return materialise(rewrite, "rewrite"), append

    @cached_property
    def all_items(self) -> DataFrame:
        rewrite, append = self.queues
        return rewrite.unionByName(append)

    @cached_property
    def merged_runs(self) -> DataFrame:
        return materialise(recover.recover_runs(*self.queues), "runs")

    @cached_property
    def merged_kvs(self) -> DataFrame:
        return materialise(recover.recover_kvs(*self.queues), "kvs")

    @cached_property
    def state(self) -> DataFrame:
        return S.region_state(self.regions, self.merged_runs, self.merged_kvs)

    @cached_property
    def span(self) -> DataFrame:
        return S.file_span(self.all_items)

    @cached_property
    def watermarks(self) -> tuple[int, int]:
        r = gc.append_watermarks(self.span).first()
        return (r.rewrite_seq, r.compact_seq) if r else (0, 0)

    @cached_property
    def requests(self) -> DataFrame:
        """One read a region: ten entries from the one after its first."""
        return self.ends.select("region_id", (F.col("first_index") + 1).alias("begin"), (F.col("first_index") + 11).alias("end"))


def query(f: Callable[[Log], DataFrame]) -> Callable[[Log], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Log(spark, sf_dir))
    return f


def text(c: str):
    return F.col(c).cast("string").alias(c)


def queue_int(df: DataFrame) -> DataFrame:
    return df.withColumn("queue", F.col("queue").cast("int"))


# ---- scans


@query
def log_items_dump(log: Log) -> DataFrame:
    return queue_int(log.items).select("queue", "file_seq", "lsn", "region_id", "kind", "first_index", "last_index", text("key"), text("value")).orderBy("lsn")


@query
def dump_filtered_groups(log: Log) -> DataFrame:
    return log.items.where(F.col("region_id").isin(1, 2, 3, 5, 8, 13)).select("lsn", "region_id", "kind", "first_index", "last_index")


@query
def file_hole_trim(log: Log) -> DataFrame:
    files = log.items.where(F.col("file_seq") % 7 != 3).select("queue", "file_seq").distinct()
    return queue_int(integrity.trim_files(files)).select("queue", "file_seq")


@query
def fork_plan(log: Log) -> DataFrame:
    return queue_int(integrity.fork_plan(log.all_items.select("queue", "file_seq").distinct()))


def raw_log(log: Log, mode: str) -> DataFrame:
    """The log as raw files, ten operations a batch, each entry 'region:index', and read back."""
    entry = F.transform(F.sequence("first_index", "last_index"), lambda i: F.concat(F.col("region_id").cast("string"), F.lit(":"), i.cast("string")).cast("binary"))
    table = log.items.select("queue", "file_seq", "lsn", F.floor(F.col("lsn") / 10).cast("long").alias("batch_id"), "region_id", "kind", "first_index", "key", "value", F.when(F.col("kind") == "ENTRIES", entry).alias("payloads"))
    folder = scratch(log.spark, "raw")
    rawlog.write_table(table, folder, threshold=64).write.parquet(f"{folder}-files")
    rawlog.register(log.spark)
    raw = log.spark.read.format("raw_log").options(path=folder, mode=mode).load()
    return raw.withColumns({c: F.col(c).cast("long") for c in ("region_id", "first_index", "last_index")})


@query
def raw_log_dump(log: Log) -> DataFrame:
    raw = raw_log(log, "dump")
    n = F.row_number().over(Window.partitionBy("queue", "file_seq").orderBy("lsn"))
    size = F.aggregate("payloads", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p))
    return queue_int(raw).select("queue", "file_seq", n.alias("n"), "region_id", "kind", "first_index", "last_index", text("key"), text("value"), size.alias("payload_bytes"))


@query
def raw_log_recovered(log: Log) -> DataFrame:
    """Live runs of the raw files, in their own order of places."""
    raw = raw_log(log, "absolute-consistency")
    return fold.live_runs(raw, chunk=RAW_CHUNK).select("region_id", "file_seq", "lo", "hi")


# ---- fold


@query
def live_runs(log: Log) -> DataFrame:
    return queue_int(log.runs).select("region_id", "lsn", "queue", "file_seq", "lo", "hi")


@query
def live_runs_chunked(log: Log) -> DataFrame:
    return queue_int(fold.live_runs(log.items, chunk=1000)).select("region_id", "lsn", "queue", "file_seq", "lo", "hi")


@query
def live_runs_with_holes(log: Log) -> DataFrame:
    return fold.live_runs(derived.with_holes(log.items), holes=True, chunk=500).select("region_id", "lsn", "lo", "hi")


@query
def live_entries(log: Log) -> DataFrame:
    return fold.live_entries(log.runs).select("region_id", "index", "lsn", "file_seq")


@query
def overwritten_entries(log: Log) -> DataFrame:
    return fold.lost_entries(log.items).where("overwritten > 0").select("region_id", "lsn", "overwritten")


@query
def compacted_entries(log: Log) -> DataFrame:
    return fold.lost_entries(log.items).where("compacted > 0").select("region_id", "lsn", "compacted")


@query
def cleaned_entries(log: Log) -> DataFrame:
    return fold.lost_entries(log.items).where("cleaned > 0").groupBy("region_id").agg(F.sum("cleaned").alias("cleaned"))


@query
def cleaned_groups(log: Log) -> DataFrame:
    return fold.last_clean(log.items)


@query
def tombstones(log: Log) -> DataFrame:
    return fold.cleaned_regions(log.items)


@query
def strict_violations(log: Log) -> DataFrame:
    return fold.strict_violations(derived.with_holes(log.items))


@query
def strict_violations_clean_log(log: Log) -> DataFrame:
    return fold.strict_violations(log.items).select("region_id", "lsn", "reason")


# ---- reads


@query
def first_last_index(log: Log) -> DataFrame:
    return log.ends.select("region_id", "first_index", "last_index")


@query
def raft_groups(log: Log) -> DataFrame:
    return log.regions


@query
def is_empty(log: Log) -> DataFrame:
    return log.regions.agg((F.count("*") == 0).alias("is_empty"))


@query
def get_entry(log: Log) -> DataFrame:
    wanted = log.ends.select("region_id", F.floor((F.col("first_index") + F.col("last_index")) / 2).cast("long").alias("index"))
    return reads.get_entry(wanted, log.runs).select("region_id", "index", "lsn", "file_seq")


@query
def fetch_entries(log: Log) -> DataFrame:
    return reads.fetch_entries(log.requests, log.runs).select("region_id", "index", "lsn", "file_seq")


@query
def fetch_entries_max_size(log: Log) -> DataFrame:
    requests = log.requests.withColumn("max_size", F.lit(150).cast("long"))
    return reads.fetch_entries(requests, log.runs, derived.entry_size()).select("region_id", "index", F.col("size").cast("long").alias("size"))


@query
def fetch_status(log: Log) -> DataFrame:
    shift = F.pmod("region_id", F.lit(5)) - 2
    every = log.items.select("region_id").distinct()
    requests = every.join(log.ends, "region_id", "left").select("region_id", (F.coalesce("first_index", F.lit(1)) + shift).alias("begin"), (F.coalesce("last_index", F.lit(5)) + 1 + shift).alias("end"))
    return reads.fetch_status(requests, log.runs, log.regions)


@query
def compact_to_result(log: Log) -> DataFrame:
    requests = log.regions.join(log.ends, "region_id", "left").select("region_id", (F.coalesce("first_index", F.lit(1)) + F.pmod("region_id", F.lit(40)) - 5).alias("index"))
    return reads.compact_result(requests, log.runs)


@query
def kv_live(log: Log) -> DataFrame:
    return log.kvs.select("region_id", text("key"), text("value"), "file_seq", "lsn")


@query
def kv_get(log: Log) -> DataFrame:
    requests = log.regions.select("region_id", F.concat(F.lit("k"), F.pmod("region_id", F.lit(10)).cast("string")).cast("binary").alias("key"))
    return reads.kv_get(requests, log.kvs).select("region_id", text("key"), text("value"))


@query
def kv_scan_range(log: Log) -> DataFrame:
    return reads.kv_scan(log.kvs, b"k2", b"k7").select("region_id", text("key"), text("value"))


@query
def kv_scan_reverse_limit(log: Log) -> DataFrame:
    return reads.kv_scan(log.kvs, reverse=True, limit=3).select("region_id", text("key"), text("value"))


@query
def kv_scan_messages(log: Log) -> DataFrame:
    number = F.try_to_number(F.nullif(F.regexp_extract(F.col("value").cast("string"), r"\{\"k\": ([0-9]*[02468])\}", 1), F.lit("")), F.lit("999999999")).cast("long")
    return reads.decode(log.kvs, number, strict=False).select("region_id", text("key"), "message")


@query
def kv_get_messages(log: Log) -> DataFrame:
    number = F.regexp_extract(F.col("value").cast("string"), "([0-9]+)", 1).cast("long")
    return reads.decode(log.kvs, number, strict=True).select("region_id", text("key"), "message")


@query
def entries_before_gate(log: Log) -> DataFrame:
    return reads.entries_before(log.merged_runs, log.last_file * 3 // 4).select("region_id", "file_seq", "lo", "hi")


@query
def rewritten_entries(log: Log) -> DataFrame:
    return reads.rewritten_entries(log.merged_runs).select("region_id", "file_seq", "lo", "hi")


@query
def kvs_before_gate(log: Log) -> DataFrame:
    return reads.kvs_before(log.merged_kvs, log.last_file * 3 // 4).select("region_id", text("key"), "file_seq")


@query
def rewritten_kvs(log: Log) -> DataFrame:
    return reads.rewritten_kvs(log.merged_kvs).select("region_id", text("key"), "file_seq")


@query
def batch_first_index(log: Log) -> DataFrame:
    entries = log.items.where("kind = 'ENTRIES'").withColumn("batch_id", F.floor(F.col("lsn") / 10).cast("long"))
    return entries.groupBy("batch_id").agg(F.min_by("first_index", "lsn").alias("first_index"), F.min_by("region_id", "lsn").alias("region_id"))


# ---- state


@query
def region_state(log: Log) -> DataFrame:
    return log.state


@query
def file_liveness(log: Log) -> DataFrame:
    return queue_int(S.file_liveness(log.all_items, log.merged_runs, log.merged_kvs))


@query
def file_span(log: Log) -> DataFrame:
    return queue_int(log.span)


@query
def total_size(log: Log) -> DataFrame:
    return queue_int(S.total_size(log.span, CONFIG.target_file_size))


@query
def used_size(log: Log) -> DataFrame:
    return S.used_size(log.span, CONFIG.target_file_size)


@query
def file_at(log: Log) -> DataFrame:
    return queue_int(S.file_at(log.span, 0.35))


@query
def file_references(log: Log) -> DataFrame:
    applied = log.items.groupBy("queue").agg((F.max("lsn") - 750).alias("lsn"))
    return queue_int(S.file_references(log.items, applied))


@query
def region_slots(log: Log) -> DataFrame:
    ids = log.items.select("region_id").distinct()
    return ids.select("region_id", slot(F.col("region_id")).alias("slot"))


@query
def live_counts_by_queue(log: Log) -> DataFrame:
    return queue_int(S.live_counts(log.merged_runs, log.merged_kvs))


@query
def garbage_ratio(log: Log) -> DataFrame:
    return S.garbage_ratio(log.all_items, log.merged_runs, log.merged_kvs)


@query
def nth_entry_file(log: Log) -> DataFrame:
    return S.nth_entry_seq(log.merged_runs, log.regions.select("region_id", F.lit(5).cast("long").alias("n")))


@query
def memory_usage(log: Log) -> DataFrame:
    return S.memory_usage(log.state)


@query
def approx_size(log: Log) -> DataFrame:
    body = F.when(F.col("kind") == "ENTRIES", 16 + 8 * (F.col("last_index") - F.col("first_index") + 1)).when(F.col("kind") == "COMPACT", 9).when(F.col("kind") == "CLEAN", 1)
    size = 9 + F.coalesce(body, 17 + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)))
    return log.items.groupBy("file_seq").agg(F.sum(size.cast("long")).alias("approx_size"), F.count("*").alias("n"))


@query
def size_histogram(log: Log) -> DataFrame:
    entries = fold.live_entries(log.runs).withColumn("size", derived.entry_size())
    return S.histogram(entries, "size", 16.0, 1.25, 8).withColumn("bucket", F.col("bucket").cast("int"))


@query
def latency_percentiles(log: Log) -> DataFrame:
    return S.latency_summary(log.spark.read.parquet(f"{log.sf_dir}/events.parquet"), "value")


@query
def worker_fairness(log: Log) -> DataFrame:
    return S.fairness(log.items, "region_id")


@query
def write_bandwidth(log: Log) -> DataFrame:
    sized = log.items.withColumn("size", F.when(F.col("kind") == "ENTRIES", 48 * (F.col("last_index") - F.col("first_index") + 1)).otherwise(F.lit(24)).cast("long"))
    return queue_int(S.write_bandwidth(sized, "size", "lsn"))


@query
def perf_context(log: Log) -> DataFrame:
    """Additive durations of each worker, as sums of its operations' values by kind."""
    events = log.spark.read.parquet(f"{log.sf_dir}/events.parquet")
    return events.groupBy("event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("total_us"), F.count("*").alias("n"))


# ---- garbage collection


@query
def needs_rewrite(log: Log) -> DataFrame:
    garbage = S.garbage_ratio(log.all_items, log.merged_runs, log.merged_kvs)
    return queue_int(gc.needs_rewrite(log.span, garbage, CONFIG.target_file_size, CONFIG.purge_threshold, CONFIG.purge_rewrite_threshold, CONFIG.purge_rewrite_garbage_ratio))


@query
def append_watermarks(log: Log) -> DataFrame:
    return gc.append_watermarks(log.span)


@query
def purge_candidates(log: Log) -> DataFrame:
    counters = log.regions.select("region_id", F.pmod("region_id", F.lit(11)).cast("int").alias("counter"))
    return gc.purge_candidates(log.state, log.merged_runs, *log.watermarks, counters)


@query
def rewrite_rewrite_regions(log: Log) -> DataFrame:
    return gc.rewrite_rewrite_regions(log.state)


@query
def rewrite_set(log: Log) -> DataFrame:
    rewrite_seq, compact_seq = log.watermarks
    candidates = gc.purge_candidates(log.state, log.merged_runs, rewrite_seq, compact_seq)
    chosen = gc.rewrite_items(log.items, log.merged_runs, log.merged_kvs, candidates, rewrite_seq)
    return chosen.select("region_id", "kind", "first_index", "last_index", text("key"), "lsn")


@query
def apply_rewrite(log: Log) -> DataFrame:
    gate = log.last_file * 3 // 4
    before = reads.entries_before(log.runs, gate).select("region_id", F.col("lo").alias("first_index"), F.col("hi").alias("last_index"))
    return queue_int(gc.apply_rewrite(log.runs, before, gate, 9)).select("region_id", "queue", "file_seq", "lo", "hi")


@query
def apply_rewrite_keys(log: Log) -> DataFrame:
    gate = log.last_file * 3 // 4
    return queue_int(gc.apply_rewrite_keys(log.kvs, reads.kvs_before(log.kvs, gate), gate, 9)).select("region_id", text("key"), "queue", "file_seq")


@query
def purge_point(log: Log) -> DataFrame:
    return queue_int(gc.purge_point(log.state, log.span))


@query
def purge_point_barrier(log: Log) -> DataFrame:
    return queue_int(gc.purge_point(log.state, log.span, 2))


@query
def purgeable_files(log: Log) -> DataFrame:
    return queue_int(gc.purgeable_files(log.all_items, gc.purge_point(log.state, log.span)))


@query
def pinned_groups(log: Log) -> DataFrame:
    groups = log.regions.where("region_id % 3 = 0").select("region_id", F.lit(1).cast("long").alias("start_seq"), F.lit(4).cast("long").alias("end_seq"))
    return S.pin_atomic_groups(log.state, groups).select("region_id", "min_append_seq", "min_rewrite_seq")


# ---- recovery


@query
def merge_queues(log: Log) -> DataFrame:
    return queue_int(log.merged_runs).select("region_id", "lsn", "queue", "file_seq", "lo", "hi")


@query
def recovered_entries(log: Log) -> DataFrame:
    """The entries that both queues together give back; the SQL folds the whole log instead."""
    return fold.live_entries(log.merged_runs).select("region_id", "index")


@query
def recovered_kvs(log: Log) -> DataFrame:
    return log.merged_kvs.select("region_id", text("key"), text("value"))


@query
def atomic_groups(log: Log) -> DataFrame:
    markers = log.items.where("kind IN ('PUT', 'DEL', 'COMPACT')").select(F.col("region_id").alias("group_id"), "lsn", (F.col("lsn") % 3).cast("int").alias("status"))
    return recover.atomic_groups(markers)


# ---- integrity


@query
def consistency_check(log: Log) -> DataFrame:
    return integrity.consistency_check(derived.with_holes(log.items))


@query
def repair_filter(log: Log) -> DataFrame:
    from .filters import keep_recent

    kept = integrity.repair(derived.with_holes(log.items), keep_recent)
    return kept.select("lsn", "region_id", "kind", "first_index", "last_index", "inserted")


@query
def checksum_crc32(log: Log) -> DataFrame:
    return log.kvs.select("region_id", text("key"), F.crc32("value").alias("crc"), C.checksum(F.col("value"), F.col("file_seq")).alias("signed_crc"))


@query
def batch_merge(log: Log) -> DataFrame:
    pair = log.items.where("kind <> 'CLEAN'").select(F.floor(F.col("lsn") / 20).cast("long").alias("batch_id"), "lsn", "region_id", "kind")
    n = F.row_number().over(Window.partitionBy("batch_id").orderBy("lsn")) - 1
    return pair.select("batch_id", n.cast("int").alias("item_no"), "lsn", "region_id", "kind")


@query
def aligned_offsets(log: Log) -> DataFrame:
    x = F.col("lsn") * 37
    return log.items.select("lsn", C.aligned_up(x, 512).alias("up"), C.aligned_down(x, 512).alias("down"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from ..streaming.ingest import streamed_state

    return QUERIES | {"streamed_first_last": streamed_state}
