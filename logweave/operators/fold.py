"""The fold of an ordered operation log into its live state, as window functions.

Every row of ``items`` is one operation of a region: an ENTRIES run [first_index, last_index], a COMPACT
to first_index, a CLEAN, or a PUT / DEL of a key. An ENTRIES row is alive unless a CLEAN follows; what
is left of its run lies from the largest later COMPACT index up to just before the smallest later
ENTRIES start. Rows are therefore read newest first, so that "later" is a frame that grows from the
start of the partition and each window is linear.

A region's log is cut into chunks of ``CHUNK`` log positions, dealt over all tasks: each chunk is
folded by itself, and what a region's other chunks do to it is a row a chunk. So no region, however
many of all rows it holds, is one task's work.

Runs are clipped, never exploded, until entries are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_entries, is_internal

RUNS = ["region_id", "lsn", "queue", "file_seq", "lo", "hi"]
#: Log positions of a chunk.
CHUNK = 1 << 20
BY = ["region_id", "chunk"]


def _terms() -> dict[str, Column]:
    return {
        "starts": F.when(is_entries(F.col("kind")), F.col("first_index")),
        "floor": F.when(F.col("kind") == "COMPACT", F.col("first_index")),
        "cleans": F.col("kind") == "CLEAN",
    }


def chunked(items: DataFrame, chunk: int) -> DataFrame:
    """``items`` with their chunk, partitioned by region and chunk; ``lsn`` is a number or (stage, lsn)."""
    of = lambda lsn: F.floor(F.col(lsn) / F.lit(chunk)).cast("long")
    staged = isinstance(items.schema["lsn"].dataType, T.StructType)
    return items.withColumn("chunk", F.struct(F.col("lsn.stage").alias("stage"), of("lsn.lsn").alias("n")) if staged else of("lsn")).repartition(*BY)


def _clip(alive: Column, later_start: Column, later_floor: Column) -> tuple[Column, Column, Column]:
    lo = F.greatest("first_index", F.coalesce(later_floor, F.col("first_index")))
    hi = F.least("last_index", F.coalesce(later_start - 1, F.col("last_index")))
    return lo, hi, is_entries(F.col("kind")) & alive & (lo <= hi)


def _later(items: DataFrame, holes: bool, chunk: int) -> DataFrame:
    """``items`` with what comes later in their region: _dead (a clean, or with ``holes`` a run beyond a hole), the smallest
    _start and the largest _floor."""
    t = _terms()
    cut = chunked(items, chunk)
    newest = Window.partitionBy(*BY).orderBy(F.desc("lsn"))
    across = Window.partitionBy("region_id").orderBy(F.desc("chunk"))
    before = newest.rowsBetween(Window.unboundedPreceding, -1)
    ahead = across.rowsBetween(Window.unboundedPreceding, -1)
    if holes:
        last = F.expr("lead(CASE WHEN kind = 'ENTRIES' THEN last_index END) IGNORE NULLS OVER (PARTITION BY region_id, chunk ORDER BY lsn DESC)")
        cut = cut.withColumn("_wipes", t["cleans"] | F.coalesce(is_entries(F.col("kind")) & (F.col("first_index") > last + 1), F.lit(False)))
    else:
        cut = cut.withColumn("_wipes", t["cleans"])
    summary = cut.groupBy(*BY).agg(
        F.max("_wipes").alias("w"), F.min(t["starts"]).alias("s"), F.max(t["floor"]).alias("f"),
        F.min(F.when(is_entries(F.col("kind")), F.struct("lsn", F.col("first_index").alias("i")))).alias("a"),
        F.max(F.when(is_entries(F.col("kind")), F.struct("lsn", F.col("last_index").alias("i")))).alias("b"),
    )
    if holes:  # a chunk whose first run lies beyond a hole wipes all earlier chunks
        prev = F.expr("lead(b.i) IGNORE NULLS OVER (PARTITION BY region_id ORDER BY chunk DESC)")
        summary = summary.withColumn("w", F.col("w") | F.coalesce(F.col("a.i") > prev + 1, F.lit(False)))
    later = summary.select(*BY, F.max("w").over(ahead).alias("_w"), F.min("s").over(ahead).alias("_s"), F.max("f").over(ahead).alias("_f"))
    own = cut.select("*", F.max("_wipes").over(before).alias("_ow"), F.min(t["starts"]).over(before).alias("_os"), F.max(t["floor"]).over(before).alias("_of"))
    no = F.lit(False)
    return own.join(later, BY).withColumns({"_dead": F.coalesce("_ow", no) | F.coalesce("_w", no), "_start": F.least("_os", "_s"), "_floor": F.greatest("_of", "_f")})


def live_runs(items: DataFrame, holes: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Live index runs: region_id, lsn, queue, file_seq, lo, hi.

    With ``holes`` (replay of a rewritten queue) a run that starts beyond the one before it empties the region first;
    without, the log is taken to be free of holes (``strict_violations`` tells).
    """
    lo, hi, keep = _clip(~F.col("_dead"), F.col("_start"), F.col("_floor"))
    return _later(items, holes, chunk).where(keep).select("region_id", "lsn", "queue", "file_seq", lo.alias("lo"), hi.alias("hi"))


def live_entries(runs: DataFrame) -> DataFrame:
    """One row for each live entry: region_id, index, lsn, queue, file_seq."""
    return runs.select("region_id", F.explode(F.sequence("lo", "hi")).alias("index"), "lsn", "queue", "file_seq")


def last_clean(items: DataFrame) -> DataFrame:
    """region_id, clean_lsn of the regions that were ever cleaned."""
    return items.where("kind = 'CLEAN'").groupBy("region_id").agg(F.max("lsn").alias("clean_lsn"))


def live_kvs(items: DataFrame) -> DataFrame:
    """region_id, key, value, queue, file_seq, lsn of the live key-values: the last writer wins, deletes and cleans remove."""
    narrow = items.where(F.col("kind").isin("PUT", "DEL") & ~is_internal(F.col("key")))
    last = narrow.groupBy("region_id", "key").agg(F.max_by(F.struct("kind", "value", "queue", "file_seq", "lsn"), "lsn").alias("w"))
    kept = last.where("w.kind = 'PUT'").join(last_clean(items), "region_id", "left").where("clean_lsn IS NULL OR w.lsn > clean_lsn")
    return kept.select("region_id", "key", "w.value", "w.queue", "w.file_seq", "w.lsn")


def regions(items: DataFrame) -> DataFrame:
    """region_id of every region that exists: any operation but a reserved key's, after its last CLEAN, makes one."""
    touched = F.max(F.when((F.col("kind") != "CLEAN") & ~is_internal(F.col("key")), F.col("lsn")))
    cleaned = F.max(F.when(F.col("kind") == "CLEAN", F.col("lsn")))
    return items.groupBy("region_id").agg(touched.alias("t"), cleaned.alias("c")).where("t IS NOT NULL AND (c IS NULL OR t > c)").select("region_id")


def cleaned_regions(items: DataFrame) -> DataFrame:
    """region_id, clean_lsn, file_seq of regions whose last operation is a CLEAN (what a rewrite must carry as tombstones)."""
    last = items.groupBy("region_id").agg(F.max_by(F.struct("kind", "lsn", "file_seq"), "lsn").alias("w"))
    return last.where("w.kind = 'CLEAN'").select("region_id", F.col("w.lsn").alias("clean_lsn"), "w.file_seq")


def lost_entries(items: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """How many entries of each ENTRIES row later runs overwrote, compactions dropped and cleans removed."""
    folded = _later(items, False, chunk).where(is_entries(F.col("kind")))
    size = F.col("last_index") - F.col("first_index") + 1
    hi = F.least("last_index", F.coalesce(F.col("_start") - 1, F.col("last_index")))
    left = F.greatest(F.lit(0), hi - F.col("first_index") + 1)
    lo = F.greatest("first_index", F.coalesce("_floor", "first_index"))
    live = F.greatest(F.lit(0), hi - lo + 1)
    zero = F.lit(0).cast("long")
    return folded.select(
        "region_id", "lsn",
        F.when(F.col("_dead"), zero).otherwise(size - left).alias("overwritten"),
        F.when(F.col("_dead"), zero).otherwise(left - live).alias("compacted"),
        F.when(F.col("_dead"), size).otherwise(zero).alias("cleaned"),
    )


def _carry(summary: DataFrame, marker: str, *measures: str) -> DataFrame:
    """For each chunk what a region's earlier chunks leave: the last ``marker`` that isn't null, and the largest of each
    measure from its chunk on (a chunk's measures are those of its rows after its last marker)."""
    by = Window.partitionBy("region_id").orderBy("chunk")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = Window.partitionBy("region_id", "_g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = summary.select(*BY, *measures, F.count(marker).over(upto).alias("_g"), F.last(marker, True).over(upto).alias(marker))
    grown = grown.select(*BY, marker, *(F.max(m).over(since).alias(m) for m in measures))
    return grown.select(*BY, *(F.lag(c).over(by).alias(f"carry_{c}") for c in (marker, *measures)))


def strict_violations(items: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """ENTRIES rows that leave a hole or write below the first index, as a strict append would refuse them.

    region_id, lsn, first_index, expected_last, expected_first, reason ('hole' or 'compacted'). A refused row starts the
    region anew, so that one fault is reported once.
    """
    cut = chunked(items.select("region_id", "lsn", "kind", "first_index", "last_index"), chunk)
    by, back = Window.partitionBy(*BY).orderBy("lsn"), Window.partitionBy(*BY).orderBy(F.desc("lsn"))
    so_far, before = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), by.rowsBetween(Window.unboundedPreceding, -1)
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    entry = is_entries(F.col("kind"))
    floor, clean = F.when(F.col("kind") == "COMPACT", F.col("first_index")), F.col("kind") == "CLEAN"
    # what lies before each run: the run before it, compactions and cleans since
    no = F.lit(False)
    a = cut.select("*", F.last(F.when(entry, F.col("last_index")), True).over(before).alias("prev"), F.count(F.when(entry, 1)).over(before).alias("run"), F.count(F.when(entry, 1)).over(after).alias("ahead"))
    tail = a.groupBy(*BY).agg(F.max(F.when(entry, F.struct("lsn", F.col("last_index").alias("i"))))["i"].alias("prev"), F.max(F.when(F.col("ahead") == 0, floor)).alias("compact"), F.max(F.when(F.col("ahead") == 0, clean)).alias("clean"))
    run = Window.partitionBy(*BY, "run").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    b = a.select("*", F.max(floor).over(run).alias("compact"), F.max(clean).over(run).alias("clean")).join(_carry(tail, "prev", "compact", "clean"), BY)
    first = F.col("run") == 0
    b = b.withColumns({
        "prev": F.coalesce("prev", "carry_prev"),
        "compact": F.when(first, F.greatest("compact", "carry_compact")).otherwise(F.col("compact")),
        "clean": F.coalesce("clean", no) | (first & F.coalesce("carry_clean", no)),
    })
    b = b.withColumn("filled", F.col("prev").isNotNull() & ~F.col("clean") & F.coalesce(F.col("compact") <= F.col("prev"), F.lit(True)))
    b = b.withColumn("fresh", entry & ~F.coalesce(F.col("filled") & (F.col("first_index") <= F.col("prev") + 1), no))
    # the first index since the region last started anew
    c = b.select(*cut.columns, "prev", "filled", "fresh", F.count(F.when(F.col("fresh"), 1)).over(so_far).alias("life"), F.count(F.when(F.col("fresh"), 1)).over(after).alias("ahead"))
    tail = c.groupBy(*BY).agg(F.max(F.when(F.col("fresh"), F.struct("lsn", F.col("first_index").alias("i"))))["i"].alias("start"), F.max(F.when(F.col("ahead") == 0, floor)).alias("raised"))
    life = Window.partitionBy(*BY, "life").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    d = c.select("*", F.first(F.when(F.col("fresh"), F.col("first_index")), True).over(life).alias("start"), F.max(floor).over(life).alias("raised")).join(_carry(tail, "start", "raised"), BY)
    old = F.col("life") == 0
    start, raised = F.when(old, F.col("carry_start")).otherwise(F.col("start")), F.when(old, F.greatest("raised", "carry_raised")).otherwise(F.col("raised"))
    e = d.where(entry).withColumn("floor", F.when(~F.col("fresh"), F.greatest(start, F.coalesce(raised, F.lit(0)))))
    hole = F.col("filled") & (F.col("first_index") > F.col("prev") + 1)
    below = ~F.col("fresh") & (F.col("first_index") < F.col("floor"))
    return e.where(hole | below).select("region_id", "lsn", "first_index", F.col("prev").alias("expected_last"), F.col("floor").alias("expected_first"), F.when(hole, "hole").otherwise("compacted").alias("reason"))
