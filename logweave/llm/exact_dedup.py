"""Exact duplicates by skew-safe combining.

Texts are equal when identical after deleting ASCII white space. Three stages, each comparing
whole contents and not only digests:

1. locally, each task collapses the equal texts of a block of rows into one row;
2. the collapsed rows meet by (digest, content, salt), so that a group of copies that makes up a
   third of the corpus is spread over ``salts`` places;
3. the winners of the salts meet by (digest, content).

What travels back to the documents is narrow: the collapsed rows of stage 1 (a digest and the ids
of one block's copies) meet their class by digest, so a hot text has one row for each block and not
one for each copy. Should two different contents ever share a digest, those digests alone are
joined again by content.

Defined results: null counts as empty; ties go to the smallest doc_id, a null doc_id last; repeated
rows are members like any other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise, parallelism, slices, utf8

#: What an id of one more copy counts for in a block.
ID_BYTES = 64
LOCAL = "digest binary, content binary, best_len long, best_id long, n long, ids array<long>"


def local_groups(docs: DataFrame, block_bytes: int = 8 << 20, with_content: bool = True, digest_bytes: int = 32) -> DataFrame:
    """One row for each distinct text in a block of rows of a partition (stage 1)."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[bytes, list] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            rows = list(groups.items())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(c).digest()[:digest_bytes] for c, _ in rows], pa.binary()),
                    pa.array([c if with_content else None for c, _ in rows], pa.binary()),
                    pa.array([g[0] for _, g in rows], pa.int64()),
                    pa.array([g[1] for _, g in rows], pa.int64()),
                    pa.array([len(g[2]) for _, g in rows], pa.int64()),
                    pa.array([g[2] for _, g in rows], pa.list_(pa.int64())),
                ],
                ["digest", "content", "best_len", "best_id", "n", "ids"],
            )
            groups.clear()
            return out

        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            lengths = batch.column(2).to_pylist()
            for doc_id, n, text in zip(ids, lengths, utf8(batch.column(1)), strict=True):
                content = text.translate(None, SPACE)
                g = groups.get(content)
                if g is None:
                    groups[content] = [n, doc_id, [doc_id]]
                    held += len(content)
                else:
                    g[2].append(doc_id)
                    held += ID_BYTES
                    if (-n, doc_id is None, doc_id or 0) < (-g[0], g[1] is None, g[1] or 0):
                        g[0], g[1] = n, doc_id
                if held > block_bytes:
                    yield flush()
                    held = 0
        if groups:
            yield flush()

    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", chars).mapInArrow(collapse, LOCAL)


def classes(local: DataFrame, salts: int, by: list[str]) -> DataFrame:
    """``by`` (a subset of digest, content), keep_id and group_size of each class (stages 2 and 3)."""
    best = F.max(F.struct("best_len", F.col("best_id").isNotNull().alias("known"), (-F.col("best_id")).alias("neg_id"))).alias("best")
    salted = local.withColumn("salt", F.pmod(F.xxhash64("best_id"), F.lit(salts))).groupBy("digest", "content", "salt").agg(best, F.sum("n").alias("n"))
    salted = salted.select("digest", "content", F.col("best.best_len").alias("best_len"), (-F.col("best.neg_id")).alias("best_id"), "n")
    whole = salted.groupBy("digest", "content").agg(best, F.sum("n").alias("group_size"))
    return whole.select(*by, (-F.col("best.neg_id")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, salts: int | None = None, digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of ``docs``.

    ``salts`` (16 or as many as there are shuffle partitions) grow with the cluster; ``digest_bytes`` shortens the digest,
    tests force collisions with it.
    """
    salts = salts or max(16, parallelism(docs.sparkSession))
    found = materialise(classes(local_groups(docs, digest_bytes=digest_bytes), salts, ["digest"]), "classes")
    shared = found.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select("digest")
    members = local_groups(docs, with_content=False, digest_bytes=digest_bytes).select("digest", "ids")
    if shared.isEmpty():
        rows = members.join(found, "digest")
    else:
        again = local_groups(docs, digest_bytes=digest_bytes)
        few = classes(again.join(shared, "digest", "left_semi"), salts, ["digest", "content"])
        rows = members.join(found.join(shared, "digest", "left_anti"), "digest").unionByName(again.select("digest", "content", "ids").join(few, ["digest", "content"]).drop("content"))
    rows = rows.select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "digest")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_first(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that stay; of repeated rows with one doc_id each stays or goes with its id."""
    kept = exact_dedup(docs, salts).where("kept").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_keep"]), "left_semi")
