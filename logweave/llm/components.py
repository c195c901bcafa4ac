"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round keeps at most as many edges as there are nodes and links; nothing is collected but a
row of counts. Before the first round every partition replaces its edges by a spanning forest. The
neighbours of a node with many stay where they lie: its least neighbour is sent to them.

``component_store`` does it for nodes that are hashes, in packed arrays: each node has one parent, a
smaller one, in a sorted array. Rounds halve the ways to the roots, and of several parents that a node
is given the least stays and is linked to the others, until none are left to link.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, free_shuffles, join_counted, materialise, scratch
from .hashstore import BLOCK, Store, block_batch, pack, to_blocks, unpack, write_array

U = np.uint64


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node but the roots, roots being the smallest nodes of the components of these edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 2_000_000:
            if len(done := forest(a, b)[0]) > len(a) // 2:  # little to gain here: pass on
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                done = a = b = np.zeros(0, np.int64)
            else:
                a, b = forest(a, b)
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (longs) of every node of ``edges`` (columns a and b, longs) that isn't its own root."""
    flow = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    now = materialise(flow(edges.select("a", "b").mapInArrow(_local, "a long, b long")), "edges")
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("n"))
        met = join_counted(both, low, ["a"], "n", 2 * before[0])
        large = materialise(flow(met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = join_counted(large, least, ["a"], "n", before[0]).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        following = materialise(flow(small), "edges")
        drop_scratch(now.sparkSession, now)
        drop_scratch(now.sparkSession, large)
        now, after = following, mark(following)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def edge_blocks(edges: Iterable[tuple[np.ndarray, np.ndarray]], bits: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Packed (node, smaller node) of a spanning forest of the edges (arrays of longs), dealt by node."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x).view(U) for x in zip(*held, strict=True))
        return forest(a, b)

    for a, b in edges:
        if len(a):
            held.append((a, b))
            n += len(a)
        if n > most:
            held = [flush()]
            n = len(held[0][0])
            if n > most // 2:  # little to gain here: pass on
                yield block_batch(list(to_blocks(held[0][0], list(held[0]), bits)))
                held, n = [], 0
    if held:
        node, root = flush()
        yield block_batch(list(to_blocks(node, [node, root], bits)))


def component_store(blocks: DataFrame, bits: int) -> Store:
    """The store of (node, root), unsigned, of every node that isn't its own root; ``blocks`` as of ``edge_blocks``."""
    spark = blocks.sparkSession

    def step(blocks: DataFrame) -> tuple[Store, DataFrame, list]:
        folder = scratch(spark, "parents")

        def hook(key, table):
            bucket = key[0].as_py()
            node, parent = (np.concatenate(c) for c in zip(*(unpack(p.as_py(), ["u8", "u8"]) for p in table.column("payload")), strict=True))
            order = np.lexsort((parent, node))
            node, parent = node[order], parent[order]
            new = np.ones(len(node), bool)
            new[1:] = node[1:] != node[:-1]
            first = np.flatnonzero(new)
            least = parent[first]
            write_array(folder, str(bucket), [node[first], least])
            least = least[np.cumsum(new) - 1]
            a, b = forest(parent[parent != least], least[parent != least])  # what the other parents of a node still link
            return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(first)], pa.int64()), "open": pa.array([len(a)], pa.int64()), "payload": pa.array([pack([a, b])], pa.binary())})

        done = materialise(blocks.groupBy("bucket").applyInArrow(hook, "bucket int, n long, open long, payload binary"), "open")
        rows = done.select("bucket", "n", "open").collect()  # one row a bucket
        return Store(folder, bits, ["u8", "u8"], {r.bucket: r.n for r in rows}).fetch(spark), done, rows

    store, done, rows = step(blocks)
    links = sum(r.open for r in rows)
    free_shuffles(spark)
    while rows:
        parents = spark.sparkContext.broadcast(store)

        def up(x: np.ndarray, parents=parents) -> np.ndarray:
            there, (parent,) = parents.value.find(x, [1])
            return np.where(there, parent, x)

        def higher(batches: Iterator[pa.RecordBatch], parents=parents, up=up) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    node, parent = parents.value.bucket(bucket)
                    above = up(np.asarray(parent))
                    a, b = (up(up(x)) for x in unpack(payload, ["u8", "u8"]))
                    a, b = forest(a, b)
                    yield block_batch([(bucket, pack([node, above])), *to_blocks(a, [a, b], bits)])

        def moved(batches: Iterator[pa.RecordBatch], parents=parents, up=up) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = 0
                for bucket in batch.column(0).to_pylist():
                    parent = np.asarray(parents.value.bucket(bucket)[1])
                    n += int(np.count_nonzero(up(parent) != parent))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        if not links and not done.select("bucket").mapInArrow(moved, "n long").agg(F.sum("n")).first()[0]:
            break
        following, after, rows = step(done.select("bucket", "payload").mapInArrow(higher, BLOCK))
        drop_scratch(spark, store.folder)
        drop_scratch(spark, done)
        store, done = following, after
        links = sum(r.open for r in rows)
    return store
