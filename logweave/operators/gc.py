"""Garbage collection as plans: what to rewrite, what to ask users to compact, which files can go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import state as S
from .fold import cleaned_regions
from .reads import entries_before, kvs_before

# fixed values: thresholds of the planner
REWRITE_POSITION = 0.7
COMPACT_POSITION = 0.2
HEAVY_ENTRIES = 32
FORCE_AFTER = 9


def needs_rewrite(span: DataFrame, garbage: DataFrame, target_file_size: int, purge_threshold: int, rewrite_threshold: int, ratio: float) -> DataFrame:
    """queue, needs_rewrite: more than one file, over the threshold, and for the rewrite queue enough garbage."""
    sized = span.join(S.total_size(span, target_file_size), "queue").join(garbage.select(F.lit(1).cast("tinyint").alias("queue"), "ratio"), "queue", "left")
    many = F.col("active_seq") > F.col("first_seq")
    append = F.col("total_size") > F.lit(purge_threshold)
    rewrite = (F.col("total_size") > F.lit(rewrite_threshold)) & (F.col("ratio") > F.lit(ratio))
    return sized.select("queue", (many & F.coalesce(F.when(F.col("queue") == 0, append).otherwise(rewrite), F.lit(False))).alias("needs_rewrite"))


def append_watermarks(span: DataFrame) -> DataFrame:
    """rewrite_seq and compact_seq of the append queue, both below the active file; no row for a single file."""
    at = lambda p: F.least(F.col("first_seq") + F.floor((F.col("active_seq") - F.col("first_seq") + 1) * F.lit(p)).cast("long"), F.col("active_seq") - 1)
    return span.where("queue = 0 AND first_seq < active_seq").select(at(REWRITE_POSITION).alias("rewrite_seq"), at(COMPACT_POSITION).alias("compact_seq"))


def purge_candidates(state: DataFrame, runs: DataFrame, rewrite_seq: int, compact_seq: int, counters: DataFrame | None = None) -> DataFrame:
    """For each region: should_compact (tell its user), do_rewrite, and its counter of unanswered requests from now on."""
    n = state.select("region_id", F.explode(F.array(F.lit(HEAVY_ENTRIES).cast("long"), (HEAVY_ENTRIES + F.col("rewrite_count")).cast("long"))).alias("n")).distinct()
    reached = S.nth_entry_seq(runs, n).where(F.col("file_seq") <= rewrite_seq).groupBy("region_id").agg(F.collect_set("n").alias("reached"))
    joined = state.join(reached, "region_id", "left")
    joined = joined.join(counters, "region_id", "left") if counters is not None else joined.withColumn("counter", F.lit(0))
    counter = F.coalesce("counter", F.lit(0)).cast("int")
    heavy: Column = F.coalesce(F.array_contains("reached", F.lit(HEAVY_ENTRIES).cast("long")), F.lit(False))
    append_heavy = F.coalesce(F.array_contains("reached", (HEAVY_ENTRIES + F.col("rewrite_count")).cast("long")), F.lit(False))
    old = F.coalesce(F.col("min_append_seq") < compact_seq, F.lit(False)) | (F.col("rewrite_count") > 0)
    has = F.coalesce(F.col("min_append_seq") <= rewrite_seq, F.lit(False))
    ask = old & heavy
    patient = ask & (counter < FORCE_AFTER)
    return joined.select("region_id", ask.alias("should_compact"), F.when(patient, False).when(ask, has).otherwise(~append_heavy & has).alias("do_rewrite"), F.when(patient, counter + 1).otherwise(0).cast("int").alias("counter"))


def rewrite_rewrite_regions(state: DataFrame) -> DataFrame:
    """Regions with anything in the rewrite queue, and whether their users should compact (over the heavy limit)."""
    return state.where("min_rewrite_seq IS NOT NULL").select("region_id", (F.col("rewrite_count") > HEAVY_ENTRIES).alias("should_compact"))


def rewrite_items(items: DataFrame, runs: DataFrame, kvs: DataFrame, candidates: DataFrame, gate: int) -> DataFrame:
    """What an append rewrite writes: tombstones of cleaned regions, then the candidates' leading entries and key-values up to ``gate``."""
    chosen = candidates.where("do_rewrite").select("region_id")
    clean = cleaned_regions(items).select("region_id", F.lit("CLEAN").alias("kind"), F.lit(None).cast("long").alias("first_index"), F.lit(None).cast("long").alias("last_index"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"), F.col("clean_lsn").alias("lsn"))
    entries = entries_before(runs, gate).join(chosen, "region_id", "left_semi").select("region_id", F.lit("ENTRIES").alias("kind"), F.col("lo").alias("first_index"), F.col("hi").alias("last_index"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"), "lsn")
    puts = kvs_before(kvs, gate).join(chosen, "region_id", "left_semi").select("region_id", F.lit("PUT").alias("kind"), F.lit(None).cast("long").alias("first_index"), F.lit(None).cast("long").alias("last_index"), "key", "value", "lsn")
    return clean.unionByName(entries).unionByName(puts)


def apply_rewrite(runs: DataFrame, rewritten: DataFrame, gate: int | None, seq: int) -> DataFrame:
    """Live runs after the entries of ``rewritten`` (region_id, first_index, last_index) moved to rewrite file ``seq``.

    With a gate, the move stops at the first entry whose append file is newer; without, at the first append entry.
    """
    span = rewritten.groupBy("region_id").agg(F.min("first_index").alias("a"), F.max("last_index").alias("b"))
    joined = runs.join(span, "region_id", "left")
    blocks = (F.col("file_seq") > gate) if gate is not None else (F.col("queue") == 0)
    within = (F.col("hi") >= F.col("a")) & (F.col("lo") <= F.col("b"))
    stops = joined.where(within & blocks).groupBy("region_id").agg(F.min(F.greatest("lo", "a")).alias("_stop"))
    cut = joined.join(stops, "region_id", "left").withColumn("upto", F.least("b", F.coalesce(F.col("_stop") - 1, F.col("b"))))
    parts = F.array(
        F.struct(F.col("lo").alias("lo"), F.least("hi", F.coalesce(F.col("a") - 1, F.col("hi"))).alias("hi"), "queue", "file_seq"),
        F.struct(F.greatest("lo", "a").alias("lo"), F.when(F.col("a").isNotNull(), F.least("hi", "upto")).alias("hi"), F.lit(1).cast("tinyint").alias("queue"), F.lit(seq).cast("long").alias("file_seq")),
        F.struct(F.greatest(F.col("lo"), F.greatest("upto", F.col("a") - 1) + 1).alias("lo"), F.when(F.col("a").isNotNull(), F.col("hi")).alias("hi"), "queue", "file_seq"),
    )
    rows = cut.select("region_id", "lsn", F.explode(parts).alias("p"))
    return rows.where("p.lo <= p.hi").select("region_id", "lsn", "p.queue", "p.file_seq", "p.lo", "p.hi")


def apply_rewrite_keys(kvs: DataFrame, rewritten: DataFrame, gate: int | None, seq: int) -> DataFrame:
    """Live key-values after the keys of ``rewritten`` moved to rewrite file ``seq``: gone and newer ones stay as they are."""
    marked = kvs.join(rewritten.select("region_id", "key", F.lit(True).alias("_moved")).distinct(), ["region_id", "key"], "left")
    old = ((F.col("queue") == 0) & (F.col("file_seq") <= gate)) if gate is not None else (F.col("queue") == 1)
    moves = F.coalesce(F.col("_moved") & old, F.lit(False))
    return marked.select("region_id", "key", "value", F.when(moves, F.lit(1).cast("tinyint")).otherwise(F.col("queue")).alias("queue"), F.when(moves, F.lit(seq).cast("long")).otherwise(F.col("file_seq")).alias("file_seq"), "lsn")


def purge_point(state: DataFrame, span: DataFrame, barrier: int | None = None) -> DataFrame:
    """For each queue the file below which nothing is needed: the oldest live one, the active one or the barrier."""
    live = F.array(F.struct(F.lit(0).cast("tinyint").alias("queue"), F.col("a").alias("live_seq")), F.struct(F.lit(1).cast("tinyint").alias("queue"), F.col("r").alias("live_seq")))
    least = state.agg(F.min("min_append_seq").alias("a"), F.min("min_rewrite_seq").alias("r")).select(F.inline(live))
    cap = F.least("active_seq", F.lit(barrier).cast("long")) if barrier is not None else F.col("active_seq")
    return span.join(least, "queue", "left").select("queue", F.least("live_seq", cap).alias("purge_seq"))


def purgeable_files(items: DataFrame, points: DataFrame) -> DataFrame:
    """queue, file_seq of the files below their queue's purge point."""
    return items.select("queue", "file_seq").distinct().join(F.broadcast(points), "queue").where("file_seq < purge_seq").select("queue", "file_seq")  # points: a row a queue
