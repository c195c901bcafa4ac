"""Recovery of the live state from two queues, and atomic groups of rewritten batches.

The rewrite queue is folded first (holes allowed), together with the append queue's tombstones, which
come after all of it; then the append queue by itself; last the two are joined: where the append part
begins within or right after the rewritten part it cuts it, beyond that it replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fold import CHUNK, RUNS, live_kvs, live_runs

# fixed values: markers of atomic groups
BEGIN, MIDDLE, END = 0, 1, 2


def _staged(rewrite: DataFrame, append: DataFrame, tombstones: tuple[str, ...]) -> DataFrame:
    """Rewrite items, then the append queue's tombstones: the order is (stage, lsn)."""
    order = lambda stage: F.struct(F.lit(stage).alias("stage"), F.col("lsn").alias("lsn"))
    return rewrite.withColumn("lsn", order(0)).unionByName(append.where(F.col("kind").isin(*tombstones)).withColumn("lsn", order(1)))


def recover_runs(rewrite: DataFrame, append: DataFrame, chunk: int = CHUNK) -> DataFrame:
    old = live_runs(_staged(rewrite, append, ("CLEAN", "COMPACT")), holes=True, chunk=chunk).withColumn("lsn", F.col("lsn.lsn"))
    new = live_runs(append, chunk=chunk)
    begins = new.groupBy("region_id").agg(F.min("lo").alias("new_first"))
    ends = old.groupBy("region_id").agg(F.max("hi").alias("old_last"))
    bounds = ends.join(begins, "region_id", "left")  # a row a region
    joined = old.join(bounds, "region_id")
    kept = joined.where("new_first IS NULL OR new_first <= old_last + 1").withColumn("hi", F.least("hi", F.coalesce(F.col("new_first") - 1, F.col("hi")))).where("lo <= hi")
    return kept.select(*RUNS).unionByName(new.select(*RUNS))


def recover_kvs(rewrite: DataFrame, append: DataFrame) -> DataFrame:
    old = live_kvs(_staged(rewrite, append, ("CLEAN", "DEL"))).withColumn("lsn", F.col("lsn.lsn"))
    new = live_kvs(append)
    return old.join(new, ["region_id", "key"], "left_anti").select(*new.columns).unionByName(new)


def atomic_groups(markers: DataFrame) -> DataFrame:
    """Which marked batches (group_id, lsn, status) take effect: accepted, and the group's begin_lsn and end_lsn.

    A group is whole from a BEGIN to the first END after it with nothing but MIDDLEs between; a second BEGIN discards
    the first, and markers without a BEGIN are discarded.
    """
    by = Window.partitionBy("group_id").orderBy("lsn")
    numbered = markers.withColumn("attempt", F.count(F.when(F.col("status") == BEGIN, 1)).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    attempt = Window.partitionBy("group_id", "attempt")
    ended = numbered.withColumn("end_lsn", F.min(F.when(F.col("status") == END, F.col("lsn"))).over(attempt)).withColumn("begin_lsn", F.min("lsn").over(attempt))
    accepted = F.coalesce((F.col("attempt") > 0) & (F.col("lsn") <= F.col("end_lsn")), F.lit(False))
    return ended.select("group_id", "lsn", "status", accepted.alias("accepted"), F.when(accepted, F.col("begin_lsn")).alias("begin_lsn"), F.when(accepted, F.col("end_lsn")).alias("end_lsn"))


def only_whole_groups(items: DataFrame, marked: DataFrame) -> DataFrame:
    """Rewrite items without the batches (batch_id) of incomplete groups; ``marked`` has batch_id and accepted."""
    return items.join(marked.where("NOT accepted").select("batch_id"), "batch_id", "left_anti")
