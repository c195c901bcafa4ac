"""Point and range reads over live runs and key-values; requests come as tables, so a batch of reads is one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_last(runs: DataFrame) -> DataFrame:
    """region_id, first_index, last_index, entry_count of regions with entries."""
    return runs.groupBy("region_id").agg(F.min("lo").alias("first_index"), F.max("hi").alias("last_index"), F.sum(F.col("hi") - F.col("lo") + 1).alias("entry_count"))


def fetch_status(requests: DataFrame, runs: DataFrame, known: DataFrame) -> DataFrame:
    """The outcome of each request (region_id, begin, end): status Ok, NotFound or Compacted.

    An empty range and an unknown region are Ok with nothing; then a region without entries is NotFound, a begin below the
    first index Compacted and an end beyond the last NotFound.
    """
    state = known.select("region_id", F.lit(True).alias("_known")).join(first_last(runs), "region_id", "left")
    joined = requests.join(state, "region_id", "left")
    status = (
        F.when((F.col("end") <= F.col("begin")) | F.col("_known").isNull(), "Ok")
        .when(F.col("first_index").isNull(), "NotFound")
        .when(F.col("begin") < F.col("first_index"), "Compacted")
        .when(F.col("end") > F.col("last_index") + 1, "NotFound")
        .otherwise("Ok")
    )
    return joined.select(*requests.columns, status.alias("status"))


def fetch_entries(requests: DataFrame, runs: DataFrame, size: Column | None = None) -> DataFrame:
    """Entries of each request [begin, end) of region_id: the request's columns, index, lsn, queue, file_seq.

    Runs are clipped to the request before they are exploded. With ``size`` (an expression over region_id and index) and
    a request column max_size, entries are kept while their running size is within it, and at least one.
    """
    clipped = requests.join(runs, "region_id").where((F.col("lo") < F.col("end")) & (F.col("hi") >= F.col("begin")))
    lo, hi = F.greatest("lo", "begin"), F.least("hi", F.col("end") - 1)
    rows = clipped.select(*requests.columns, F.explode(F.sequence(lo, hi)).alias("index"), "lsn", "queue", "file_seq")
    if size is None:
        return rows
    so_far = F.sum("size").over(Window.partitionBy("region_id", "begin", "end").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("size", size).withColumn("total", so_far).where("total <= max_size OR total = size").drop("total")


def get_entry(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Where each requested (region_id, index) lies; requests without such an entry give no row."""
    return requests.join(runs, "region_id").where("index BETWEEN lo AND hi").select("region_id", "index", "lsn", "queue", "file_seq")


def compact_result(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """What a compaction of each (region_id, index) returns: the new first index less the old; 0 for regions without entries.

    When everything goes, the new first index counts as the requested one.
    """
    state = first_last(runs)
    joined = requests.join(state, "region_id", "left")
    new_first = F.when(F.col("index") > F.col("first_index"), F.col("index")).otherwise(F.col("first_index"))
    return joined.select("region_id", "index", F.coalesce(new_first - F.col("first_index"), F.lit(0)).alias("removed"))


def kv_get(requests: DataFrame, kvs: DataFrame) -> DataFrame:
    """value of each requested (region_id, key), null where there is none."""
    return requests.join(kvs.select("region_id", "key", "value"), ["region_id", "key"], "left")


def kv_scan(kvs: DataFrame, start: bytes | None = None, end: bytes | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Key-values with start <= key < end of every region, in key order; ``limit`` stops each region early."""
    if start is not None:
        kvs = kvs.where(F.col("key") >= F.lit(start))
    if end is not None:
        kvs = kvs.where(F.col("key") < F.lit(end))
    order = F.desc("key") if reverse else F.asc("key")
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("region_id").orderBy(order))
        kvs = kvs.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
    return kvs.select("region_id", "key", "value").orderBy("region_id", order)


def decode(kvs: DataFrame, parse: Column, strict: bool) -> DataFrame:
    """``message`` by an expression over value that is null where it can't be parsed: an error if strict, else skipped."""
    if strict:
        return kvs.withColumn("message", F.coalesce(parse, F.raise_error(F.concat(F.lit("can't parse the value of key "), F.hex("key")))))
    return kvs.withColumn("message", parse).where("message IS NOT NULL")


def entries_before(runs: DataFrame, gate: int) -> DataFrame:
    """Runs of the leading append entries whose file is at most ``gate``: the first newer one ends them."""
    newer = runs.where((F.col("queue") == 0) & (F.col("file_seq") > gate)).groupBy("region_id").agg(F.min("lo").alias("_stop"))  # a row a region
    old = runs.where((F.col("queue") == 0) & (F.col("file_seq") <= gate))
    return old.join(newer, "region_id", "left").where("_stop IS NULL OR lo < _stop").select(*runs.columns)


def rewritten_entries(runs: DataFrame) -> DataFrame:
    return runs.where("queue = 1")


def kvs_before(kvs: DataFrame, gate: int) -> DataFrame:
    return kvs.where((F.col("queue") == 0) & (F.col("file_seq") <= gate))


def rewritten_kvs(kvs: DataFrame) -> DataFrame:
    return kvs.where("queue = 1")
