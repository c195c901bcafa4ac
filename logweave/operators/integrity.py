"""Consistency check, file checks and repair."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Corruption
from ..functions.columns import MAX_INDEX
from .fold import CHUNK


def consistency_check(items: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """region_id, last_valid of regions whose runs leave a hole: the last index before the first one.

    Compactions and cleans are not looked at, and a loss at the head or tail can't be seen. Where both queues have a
    hole the rewrite queue's is told. A region's log is looked at in chunks (see ``fold``).
    """
    by = ["queue", "region_id", "chunk"]
    runs = items.where("kind = 'ENTRIES'").select("queue", "region_id", "lsn", "first_index", "last_index")
    cut = runs.withColumn("chunk", F.floor(F.col("lsn") / F.lit(chunk)).cast("long")).repartition(*by)
    ends = cut.groupBy(*by).agg(F.max_by("last_index", "lsn").alias("end"))
    before = ends.select(*by, F.lag("end").over(Window.partitionBy("queue", "region_id").orderBy("chunk")).alias("carry"))
    inside = F.lag("last_index").over(Window.partitionBy(*by).orderBy("lsn"))
    broken = cut.withColumn("prev", inside).join(before, by).withColumn("prev", F.coalesce("prev", "carry")).where("prev + 1 < first_index")
    by_queue = broken.groupBy("region_id", "queue").agg(F.min_by("prev", "lsn").alias("prev"))
    return by_queue.groupBy("region_id").agg(F.max_by("prev", "queue").alias("last_valid"))


def trim_files(files: DataFrame) -> DataFrame:
    """Of the files (queue, file_seq) the newest run without a gap, per queue."""
    gap = F.col("file_seq") - F.lag("file_seq").over(Window.partitionBy("queue").orderBy("file_seq")) != 1
    marked = files.withColumn("_start", F.when(gap, F.col("file_seq")))
    newest = F.max("_start").over(Window.partitionBy("queue"))
    return marked.withColumn("_newest", newest).where("_newest IS NULL OR file_seq >= _newest").drop("_start", "_newest")


def fork_plan(files: DataFrame, recycles: bool = False) -> DataFrame:
    """queue, file_seq, how: sealed files are linked, each queue's newest is copied."""
    if recycles:
        raise ValueError("a log that recycles its files can't be forked")
    newest = F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("file_seq"))) == 1
    return files.select("queue", "file_seq", F.when(newest, "copied").otherwise("linked").alias("how"))


# fixed values: what a repair filter may answer
DEFAULT, DISCARD_INCOMING, DISCARD_EXISTING = 0, 1, 2


@dataclass
class RegionView:
    """The simple view of a region that repair filters decide by: its first index, count and rewritten count."""

    first: int = 0
    count: int = 0
    rewritten: int = 0

    def clear(self) -> None:
        self.first = self.count = self.rewritten = 0

    def entries(self, queue: int, a: int, b: int) -> None:
        if self.count:
            if a > self.first + self.count or a < self.first:
                if queue == 0:
                    raise Corruption(f"entries from {a} don't fit [{self.first}, {self.first + self.count})")
                self.clear()
            elif queue == 1 and a > self.first + self.rewritten:
                raise Corruption("rewritten entries are not contiguous")
        if not self.count:
            self.first = a
        self.count = b - self.first + 1
        self.rewritten = self.count if queue == 1 else a - self.first

    def compact(self, to: int) -> None:
        if self.count and to > self.first:
            if to >= self.first + self.count - 1:
                self.clear()
            else:  # the count stays, as the format's repair has it
                self.first, self.rewritten = to, max(0, self.rewritten - (to - self.first))


Filter = Callable[[int, RegionView, int, str, int | None, int | None], int]


def repair(items: DataFrame, decide: Filter) -> DataFrame:
    """The items that a repair keeps, in order, with the COMPACT rows that it inserts (``inserted``).

    ``decide(region_id, view, queue, kind, first_index, last_index)`` answers 0 (as usual), 1 (drop the item) or 2
    (drop what exists, then apply the item); key-values are never asked about. Regions are streamed in order, so a
    region of any size needs the memory of one view. A new log is returned; nothing is changed in place.
    """
    names = items.columns
    at = {c: names.index(c) for c in ("region_id", "queue", "kind", "first_index", "last_index")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, view = None, RegionView()
        for batch in batches:
            rid, queue, kind, a, b = (batch.column(at[c]).to_pylist() for c in ("region_id", "queue", "kind", "first_index", "last_index"))
            keep, inserted = [], []
            for i in range(batch.num_rows):
                if rid[i] != region:
                    region, view = rid[i], RegionView()
                answer = DEFAULT if kind[i] in ("PUT", "DEL") else decide(rid[i], view, queue[i], kind[i], a[i], b[i])
                if answer == DISCARD_INCOMING:
                    continue
                if answer == DISCARD_EXISTING:
                    view.clear()
                    keep.append(i)
                    inserted.append(True)
                if kind[i] == "ENTRIES":
                    view.entries(queue[i], a[i], b[i])
                elif kind[i] == "COMPACT":
                    view.compact(a[i])
                elif kind[i] == "CLEAN":
                    view.clear()
                keep.append(i)
                inserted.append(False)
            out = batch.take(pa.array(keep, pa.int64()))
            flags = pa.array(inserted, pa.bool_())
            yield pa.RecordBatch.from_arrays([*out.columns, flags], [*names, "inserted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", inserted boolean"
    ordered = items.repartition("region_id").sortWithinPartitions("region_id", F.desc("queue"), "file_seq", "lsn")  # rewritten items are the older ones
    kept = ordered.mapInArrow(run, schema)
    null = lambda c: F.when(F.col("inserted"), F.lit(None)).otherwise(F.col(c)).alias(c)
    change = {"kind": F.when(F.col("inserted"), "COMPACT").otherwise(F.col("kind")).alias("kind"), "first_index": F.when(F.col("inserted"), F.lit(MAX_INDEX)).otherwise(F.col("first_index")).alias("first_index")}
    return kept.select(*(change.get(c) if c in change else null(c) if c in ("last_index", "key", "value") else F.col(c) for c in names), "inserted")
