"""The engine facade: a log table on disk, reads over its live state, garbage collection as plans.

The table is Parquet, partitioned by queue and file_seq, appended to in atomic batches. Nothing is kept
in memory: every read is a plan over the table as it is, so that reads are snapshots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig
from ..errors import STATUS, DecodeFailure
from ..functions.columns import is_internal
from ..operators import batch as B
from ..operators import fold, gc, integrity, reads, recover
from ..operators import state as S


class LogEngine:
    """``LogEngine(spark, path)`` opens (or starts) the log table at ``path``."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), (config or EngineConfig(dir=path)).sanitize()
        self.listeners: list[Callable[[str, int, int], None]] = []
        self.counters: DataFrame | None = None
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._exists():
            spark.createDataFrame([], B.SCHEMA).write.partitionBy("queue", "file_seq").parquet(self.path)

    def _exists(self) -> bool:
        return self._fs.exists(self._root)

    def _notify(self, what: str, queue: int, seq: int) -> None:
        for f in self.listeners:
            f(what, queue, seq)

    # ---- the log

    @property
    def items(self) -> DataFrame:
        """All operations, in the columns of the log table."""
        return self.spark.read.schema(T._parse_datatype_string(B.SCHEMA)).parquet(self.path)

    def queue(self, queue: int) -> DataFrame:
        return self.items.where(F.col("queue") == queue)

    def write(self, *batches: B.LogBatch) -> int:
        """Append batches to the append queue in order, each atomic; returns their approximate bytes. Empty ones do nothing."""
        batches = tuple(b for b in batches if not b.is_empty())
        if not batches:
            return 0
        last = self.items.agg(F.max("lsn"), F.max("batch_id")).first()
        active = self.queue(0).agg(F.max("file_seq")).first()[0] or 1
        size = self._file_size(0, active)
        lsn, batch_id = (last[0] if last[0] is not None else -1) + 1, (last[1] if last[1] is not None else -1) + 1
        rows, total = [], 0
        for b in batches:
            if size >= self.config.target_file_size:  # before the write, so that a file may grow over its target
                active, size = active + 1, 0
                self._notify("new_file", 0, active)
            rows += b.rows(batch_id, 0, active, lsn)
            lsn, batch_id = lsn + len(b.items), batch_id + 1
            size, total = size + b.approximate_size(), total + b.approximate_size()
        self.append(self.spark.createDataFrame(rows, B.SCHEMA))
        self._notify("written", 0, active)
        return total

    def append(self, rows: DataFrame) -> None:
        """Append rows of the log table; the caller orders their lsn."""
        rows.write.mode("append").partitionBy("queue", "file_seq").parquet(self.path)

    def sync(self) -> None:
        """Writes are durable when they return."""

    def _file_size(self, queue: int, seq: int) -> int:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/queue={queue}/file_seq={seq}")
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else 0

    # ---- live state

    @property
    def runs(self) -> DataFrame:
        """Live runs; one that was rewritten (a rewritten run keeps its operation's lsn) is located in the rewrite queue."""
        copies = self.queue(1).where("kind = 'ENTRIES'").groupBy("region_id", "lsn").agg(F.max_by(F.struct("file_seq", "first_index", "last_index"), "file_seq").alias("copy"))
        joined = recover.recover_runs(self.queue(1), self.queue(0)).join(copies, ["region_id", "lsn"], "left")
        return self._moved(joined, F.coalesce((F.col("lo") >= F.col("copy.first_index")) & (F.col("hi") <= F.col("copy.last_index")), F.lit(False)))

    @property
    def kvs(self) -> DataFrame:
        """Live key-values, located as ``runs`` are."""
        copies = self.queue(1).where("kind = 'PUT'").groupBy("region_id", "key", "lsn").agg(F.struct(F.max("file_seq").alias("file_seq")).alias("copy"))
        joined = recover.recover_kvs(self.queue(1), self.queue(0)).join(copies, ["region_id", "key", "lsn"], "left")
        return self._moved(joined, F.col("copy").isNotNull())

    @staticmethod
    def _moved(rows: DataFrame, copied: Column) -> DataFrame:
        seq = F.when(copied, F.col("copy.file_seq")).otherwise(F.col("file_seq"))
        return rows.withColumn("queue", F.when(copied, F.lit(1)).otherwise(F.col("queue")).cast("tinyint")).withColumn("file_seq", seq).drop("copy")

    @property
    def regions(self) -> DataFrame:
        return fold.regions(self.items.withColumn("lsn", F.struct(F.col("queue") == 0, "lsn").alias("lsn")))

    @property
    def state(self) -> DataFrame:
        return S.region_state(self.regions, self.runs, self.kvs)

    def get(self, region_id: int, key: bytes) -> bytes | None:
        r = self.kvs.where((F.col("region_id") == region_id) & (F.col("key") == F.lit(key))).select("value").first()
        return bytes(r.value) if r else None

    def get_message(self, region_id: int, key: bytes, parse: Callable[[bytes], object]):
        """The value parsed; a failure is an error."""
        value = self.get(region_id, key)
        try:
            return None if value is None else parse(value)
        except Exception as e:
            raise DecodeFailure(str(e)) from e

    def scan(self, region_id: int, callback: Callable[[bytes, bytes], bool], start: bytes | None = None, end: bytes | None = None, reverse: bool = False) -> None:
        """Call back with each key and value in order until it returns False."""
        rows = reads.kv_scan(self.kvs.where(F.col("region_id") == region_id), start, end, reverse)
        for r in rows.toLocalIterator():
            if not callback(bytes(r.key), bytes(r.value)):
                return

    def scan_messages(self, region_id: int, parse: Callable[[bytes], object], callback: Callable[[bytes, object], bool], **bounds) -> None:
        """As ``scan``, with parsed values; those that can't be parsed are skipped."""

        def each(key: bytes, value: bytes) -> bool:
            try:
                message = parse(value)
            except Exception:  # the format's scan skips what it can't parse, whatever the parser raises
                return True
            return callback(key, message)

        self.scan(region_id, each, **bounds)

    def _with_payload(self, entries: DataFrame) -> DataFrame:
        """index and payload of located entries; payloads are joined last, by the operation they lie in."""
        stored = self.items.where("kind = 'ENTRIES'").select("queue", "file_seq", "lsn", "region_id", "first_index", "payloads")
        joined = entries.join(stored, ["queue", "file_seq", "lsn", "region_id"])
        at = F.col("index") - F.col("first_index")
        return joined.select("index", F.get("payloads", at.cast("int")).alias("payload")).orderBy("index")

    def get_entry(self, region_id: int, index: int) -> bytes | None:
        wanted = self.spark.createDataFrame([(region_id, index)], "region_id long, index long")
        r = self._with_payload(reads.get_entry(wanted, self.runs)).first()
        return bytes(r.payload) if r else None

    def fetch_entries(self, region_id: int, begin: int, end: int, max_size: int | None = None) -> list[bytes]:
        """Payloads of [begin, end); with ``max_size`` as many as fit, and at least one."""
        request = self.spark.createDataFrame([(region_id, begin, end)], "region_id long, begin long, end long")
        runs = self.runs.where(F.col("region_id") == region_id)
        status = reads.fetch_status(request, runs, self.regions).first().status
        if status in STATUS:
            raise STATUS[status](f"region {region_id}, entries [{begin}, {end})")
        out, total = [], 0
        for r in self._with_payload(reads.fetch_entries(request, runs)).toLocalIterator():
            total += len(r.payload)
            if out and max_size is not None and total > max_size:
                break
            out.append(bytes(r.payload))
        return out

    def first_index(self, region_id: int) -> int | None:
        r = reads.first_last(self.runs.where(F.col("region_id") == region_id)).first()
        return r.first_index if r else None

    def last_index(self, region_id: int) -> int | None:
        r = reads.first_last(self.runs.where(F.col("region_id") == region_id)).first()
        return r.last_index if r else None

    def region_ids(self) -> list[int]:
        return [r.region_id for r in self.regions.orderBy("region_id").toLocalIterator()]

    def is_empty(self) -> bool:
        return self.regions.isEmpty()

    def compact_to(self, region_id: int, index: int) -> int:
        """Append a compaction; returns the new first index less the old (0 without entries)."""
        old = self.first_index(region_id)
        b = B.LogBatch()
        b.compact(region_id, index)
        self.write(b)
        if old is None:
            return 0
        new = self.first_index(region_id)
        return (index if new is None else new) - old

    # ---- files and garbage collection

    @property
    def span(self) -> DataFrame:
        return S.file_span(self.items)

    def file_span(self, queue: int) -> tuple[int, int] | None:
        r = self.span.where(F.col("queue") == queue).first()
        return (r.first_seq, r.active_seq) if r else None

    def used_size(self) -> int:
        return S.used_size(self.span, self.config.target_file_size).first().used_size or 0

    def _next(self, queue: int) -> tuple[int, int]:
        """(file number, lsn) for what is written next to a queue."""
        r = self.items.agg(F.max(F.when(F.col("queue") == queue, F.col("file_seq"))), F.max("batch_id")).first()
        return (r[0] or 0) + 1, (r[1] if r[1] is not None else -1) + 1

    def _rewrite(self, rows: DataFrame) -> int:
        """Write live rows (region_id, kind, first_index, last_index, key, value, lsn, with their place) to a new rewrite file."""
        seq, batch_id = self._next(1)
        stored = self.items.where("kind = 'ENTRIES'").select(F.col("queue").alias("q"), F.col("file_seq").alias("s"), F.col("lsn").alias("lsn"), "region_id", F.col("first_index").alias("origin"), "payloads")
        joined = rows.join(stored, (rows.kind == "ENTRIES") & (rows.lsn == stored.lsn) & (rows.region_id == stored.region_id) & (rows.queue == stored.q) & (rows.file_seq == stored.s), "left").drop(stored.lsn).drop(stored.region_id)
        cut = F.when(F.col("kind") == "ENTRIES", F.slice("payloads", (F.col("first_index") - F.col("origin") + 1).cast("int"), (F.col("last_index") - F.col("first_index") + 1).cast("int")))
        out = joined.select(F.lit(1).cast("tinyint").alias("queue"), F.lit(seq).cast("long").alias("file_seq"), "lsn", F.lit(batch_id).cast("long").alias("batch_id"), F.lit(0).alias("item_no"), "region_id", "kind", "first_index", "last_index", "key", "value", cut.alias("payloads"))
        self.append(out)
        return seq

    def _purge_files(self) -> int:
        """Remove the files that nothing live needs, and that no listener wants; returns how many."""
        gone = gc.purgeable_files(self.items, gc.purge_point(self.state, self.span)).collect()  # a row a file
        for r in gone:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/queue={r.queue}/file_seq={r.file_seq}"), True)
            self._notify("purged", r.queue, r.file_seq)
        return len(gone)

    def purge_expired_files(self) -> list[int]:
        """One round of garbage collection; returns the regions that should be compacted by their users."""
        c = self.config
        should: set[int] = set()
        garbage = S.garbage_ratio(self.items, self.runs, self.kvs)
        needs = {r.queue: r.needs_rewrite for r in gc.needs_rewrite(self.span, garbage, c.target_file_size, c.purge_threshold, c.purge_rewrite_threshold, c.purge_rewrite_garbage_ratio).collect()}
        if needs.get(1):
            should |= {r.region_id for r in gc.rewrite_rewrite_regions(self.state).where("should_compact").collect()}
            self.must_rewrite_rewrite_queue()
        if needs.get(0):
            marks = gc.append_watermarks(self.span).first()
            candidates = gc.purge_candidates(self.state, self.runs, marks.rewrite_seq, marks.compact_seq, self.counters)
            decided = candidates.collect()  # a row a region
            self.counters = self.spark.createDataFrame([(r.region_id, r.counter) for r in decided], "region_id long, counter int")
            should |= {r.region_id for r in decided if r.should_compact}
            chosen = self.spark.createDataFrame([(r.region_id, r.do_rewrite) for r in decided], "region_id long, do_rewrite boolean")
            self._rewrite_append(chosen, marks.rewrite_seq)
        if needs.get(0) or needs.get(1):
            self._purge_files()
        return sorted(should)

    def _rewrite_append(self, candidates: DataFrame, gate: int) -> None:
        place = lambda df, first, last, key, value, kind: df.select("region_id", F.lit(kind).alias("kind"), first.cast("long").alias("first_index"), last.cast("long").alias("last_index"), key.cast("binary").alias("key"), value.cast("binary").alias("value"), "lsn", "queue", "file_seq")
        none = F.lit(None)
        chosen = candidates.where("do_rewrite").select("region_id")
        entries = reads.entries_before(self.runs, gate).join(chosen, "region_id", "left_semi")
        kvs = reads.kvs_before(self.kvs, gate).join(chosen, "region_id", "left_semi")
        clean = fold.cleaned_regions(self.queue(0)).select("region_id", F.col("clean_lsn").alias("lsn"), F.lit(0).cast("tinyint").alias("queue"), "file_seq")
        self._rewrite(place(clean, none, none, none, none, "CLEAN").unionByName(place(entries, F.col("lo"), F.col("hi"), none, none, "ENTRIES")).unionByName(place(kvs, none, none, F.col("key"), F.col("value"), "PUT")))

    def must_rewrite_append_queue(self) -> None:
        """Rewrite every region up to the active file, whatever the thresholds say."""
        span = self.file_span(0)
        if span:
            self._rewrite_append(self.regions.withColumn("do_rewrite", F.lit(True)), span[1])

    def must_rewrite_rewrite_queue(self) -> None:
        """Rewrite all that is live in the rewrite queue to its next file."""
        none = F.lit(None)
        old = self.runs.where("queue = 1").select("region_id", F.lit("ENTRIES").alias("kind"), F.col("lo").alias("first_index"), F.col("hi").alias("last_index"), none.cast("binary").alias("key"), none.cast("binary").alias("value"), "lsn", "queue", "file_seq")
        puts = self.kvs.where("queue = 1").select("region_id", F.lit("PUT").alias("kind"), none.cast("long").alias("first_index"), none.cast("long").alias("last_index"), "key", "value", "lsn", "queue", "file_seq")
        self._rewrite(old.unionByName(puts))

    def must_purge_all_stale(self) -> int:
        return self._purge_files()

    # ---- offline tools

    def dump(self, region_ids: list[int] | None = None) -> DataFrame:
        """All operations, rewrite queue first; with region ids only theirs."""
        items = self.items if not region_ids else self.items.where(F.col("region_id").isin(region_ids))
        return items.orderBy(F.desc("queue"), "file_seq", "lsn")

    def consistency_check(self) -> DataFrame:
        return integrity.consistency_check(self.items).orderBy("region_id")

    def repair(self, decide: integrity.Filter, to: str) -> LogEngine:
        """A repaired copy of the log at ``to``."""
        kept = integrity.repair(self.items, decide)
        kept = kept.withColumn("lsn", F.col("lsn") * 2 + F.when(F.col("inserted"), 0).otherwise(1))  # room for what was inserted before an item
        kept.withColumn("payloads", F.when(~F.col("inserted"), F.col("payloads"))).drop("inserted").write.partitionBy("queue", "file_seq").parquet(to)
        return LogEngine(self.spark, to, self.config)

    def fork(self, to: str) -> DataFrame:
        """A snapshot of the log at ``to``; tells for each file whether a file system with links would link or copy it."""
        self.items.write.partitionBy("queue", "file_seq").parquet(to)
        return integrity.fork_plan(self.items.select("queue", "file_seq").distinct())

    def user_items(self, condition: Column | None = None) -> DataFrame:
        """Operations but those of reserved keys."""
        items = self.items.where(~is_internal(F.col("key")))
        return items if condition is None else items.where(condition)
