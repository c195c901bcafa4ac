"""Line duplicates across documents, with DataFrame functions only.

The hashes of the long lines are range-partitioned by (key, slice) and sorted within by document, largest
first, then position; a slice is a part of a key's documents by hash, as many as it takes for no slice to
hold more than about ``SLICE`` rows. The sorted rows are streamed once: a line whose document differs from
that of the line before it is its document's first occurrence, the first of a slice its first holder. Only
these go on, combined by key where they are, so that a line that a third of all documents hold is many
tasks' work. Hot keys' first holders are sent to their lines, all others meet them by key. What
comes back for a document is no text but its keep bitmap, compressed to the runs of dropped lines.
The texts meet their bitmaps by document, in one exchange.

Defined results: a null or empty text is one empty line; documents are told apart by doc_id, so
rows that repeat an id count once and each gets its own result; a null doc_id sorts before all
others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_STR, join_counted, materialise, parallelism

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NULL_ID = -(1 << 63)
ROW = ["_doc", "_text_hash"]
#: Lines of a key that lie together.
SLICE = 1_000_000
#: Slices at least, so that a hot line is many ranges of a small table too.
SLICES = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _with_row_key(docs: DataFrame) -> DataFrame:
    """Rows with the same id and text are told apart by nothing and need not be."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))
    return docs.select("doc_id", "text", doc.alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_hash"))


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """_doc, _text_hash, pos and the 128-bit hash (h1, h2) of each line whose key is long enough."""
    trimmed = F.transform(lines_of(F.col("text")), lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(SPACE_STR)).alias("key")))
    long_enough = F.filter(trimmed, lambda x: F.length(x["key"]) >= min_chars)
    rows = _with_row_key(docs).select(*ROW, F.explode(long_enough).alias("l"))
    key = F.translate(F.col("l.key"), UPPER, LOWER)
    return rows.select(*ROW, F.col("l.pos").alias("pos"), key.alias("key")).select(*ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def first_occurrences(lines: DataFrame, n_lines: int) -> DataFrame:
    """h1, h2, _doc of each line, and whether it is its document's first one with that key; streamed over the sorted ranges."""
    slices = max(SLICES, n_lines // SLICE + 1)
    sliced = lines.withColumn("slice", F.pmod(F.xxhash64("_doc"), F.lit(slices)))
    ranged = sliced.repartitionByRange(parallelism(lines.sparkSession), "h1", "h2", "slice").sortWithinPartitions("h1", "h2", "slice", F.desc("_doc"), "pos")
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc("_doc"), "pos")
    before = F.lag("_doc").over(stream)
    return ranged.withColumn("before", before).select("h1", "h2", "_doc", (F.col("before").isNull() | (F.col("before") != F.col("_doc"))).alias("is_first"))


def dropped_runs(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """_doc, _text_hash, runs: the keep bitmap of each document that loses lines, as runs (start, n) of dropped lines."""
    lines = materialise(long_lines(docs, min_chars), "lines")
    n_lines = lines.count()
    first = first_occurrences(lines, n_lines).groupBy("h1", "h2").agg(F.count(F.when(F.col("is_first"), 1)).alias("n_docs"), F.max("_doc").alias("first_doc"), F.count("*").alias("n"))
    first = materialise(first.where(F.col("n_docs") >= min_docs).select("h1", "h2", "first_doc", "n"), "first")
    lost = join_counted(lines, first, ["h1", "h2"], "n", n_lines).where(F.col("_doc") != F.col("first_doc")).select(*ROW, "pos").distinct()
    island = F.col("pos") - F.row_number().over(Window.partitionBy(*ROW).orderBy("pos"))
    runs = lost.withColumn("island", island).groupBy(*ROW, "island").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n"))
    return runs.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("runs"))


def apply_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (text) of each document."""
    lost = F.coalesce(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))), F.array().cast("array<int>"))
    joined = _with_row_key(docs).join(runs, ROW, "left").select("doc_id", "text", lines_of(F.col("text")).alias("lines"), lost.alias("lost"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.size("lost") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"), kept.alias("kept"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    return apply_runs(docs, dropped_runs(docs, min_chars, min_docs))
