"""Near-duplicate documents: MinHash bands as keys, exact Jaccard similarity of word shingles, components.

A document is the set of its runs of ``shingle`` words. Of equal sets one is kept as a unit. Two sets of
similarity s share one of the band keys with a chance of 1 - (1 - s**rows)**bands: 0.9996 at 0.8.
All that share a key are compared exactly, in two steps that link the same components as all pairs:

1. Each unit with the smallest unit of each of its keys. Pairs are told apart by part of their hash, so
   that a unit with very many copies meets them in many tasks.
2. Where the members of a key are not yet in one component and are more than two, all of them, by prefix
   filter within a disjoint-set forest.

Shingle sets leave only from units that share a key.

With ``bits`` a document is linked by its SimHash too: fingerprints of the same shingles, repeats included, that
differ in at most 2 bits, found by ``simhash.near_links``. Few pairs of similarity 0.8 are that close, so one way
of linking doesn't replace the other; a class is what both link.

Defined results: words are runs of bytes outside ASCII white space, A-Z lower-cased; a text shorter than a
shingle is one shingle, one without words (null ones too) an empty set, and empty sets are equal; a null
doc_id is never kept unless all of its class are null; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import join_counted, materialise, parallelism, slices, utf8
from .components import components
from .hashstore import BLOCK, block_batch, buckets_for, build, to_blocks
from .substring_dedup import BUCKET_BYTES, cluster, prefix_size
from .words import U, blocks, join_hash, mix, shingle_hashes, word_hashes

PARTS = 16


@dataclass(frozen=True)
class Near:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 5
    bits: bool = False  # link by SimHash too


class Sets:
    """The distinct shingles of each text of a block: ``values`` sorted within a text, text i's are cuts[i]:cuts[i + 1]."""

    def __init__(self, texts: list[bytes], near: Near):
        h, first = word_hashes(texts)
        n = near.shingle
        size = np.diff(first)
        values, text = np.zeros(0, U), np.zeros(0, int)
        if len(h) >= n:
            values, inside = shingle_hashes(h, first, n)
            values, text = values[inside], np.repeat(np.arange(len(texts)), size)[inside]
        short = np.flatnonzero((size > 0) & (size < n))
        whole = h[first[short]]
        for k in range(1, n):
            more = size[short] > k
            whole[more] = join_hash(whole[more], h[first[short[more]] + k])
        values, text = np.concatenate([values, whole]), np.concatenate([text, short])
        order = np.lexsort((values, text))
        values, text = values[order], text[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        self.values = values[new]
        self.cuts = np.searchsorted(text[new], np.arange(len(texts) + 1))
        self.some = np.flatnonzero(np.diff(self.cuts))
        self.unit = np.zeros(len(texts), U)
        if len(self.some):
            self.unit[self.some] = mix(np.add.reduceat(mix(self.values), self.cuts[self.some]))

    def keys(self, near: Near) -> np.ndarray:
        """Band keys: a row for each text (none of an empty set is ever looked at)."""
        a, c = np.random.default_rng(11).integers(0, 1 << 32, (2, near.bands * near.rows), dtype=np.uint32)
        a |= np.uint32(1)
        out = np.zeros((len(self.unit), near.bands), U)
        if len(self.some):
            x, starts = (self.values >> U(32)).astype(np.uint32), self.cuts[self.some]
            for i in range(near.bands):
                key = np.full(len(starts), i, U)
                for k in range(i * near.rows, (i + 1) * near.rows):
                    key = join_hash(key, np.minimum.reduceat((x ^ c[k]) * a[k], starts).astype(U))
                out[self.some, i] = key
        return out

    def packed(self, i: int) -> bytes:
        return self.values[self.cuts[i] : self.cuts[i + 1]].tobytes()


def print_links(rows: DataFrame) -> DataFrame:
    """Edges a, b between units whose fingerprints are one component of those within two bits: each with the smallest."""
    prints = materialise(rows.select("unit", "fp").distinct(), "prints")
    roots = simhash.components(simhash.near_links(prints.select("fp").distinct()))
    rooted = materialise(prints.join(roots, prints.fp == roots.node, "left").select("unit", F.coalesce("root", "fp").alias("root")).distinct(), "print-roots")
    least = rooted.groupBy("root").agg(F.min("unit").alias("a"), F.count("*").alias("n")).where("n > 1")
    return join_counted(rooted, least, ["root"], "n", rooted.count()).where("unit <> a").select("a", F.col("unit").alias("b"))


def _read(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[tuple[list, Sets, list[bytes]]]:
    for part in slices(batches):
        ids, texts = part.column(0).to_pylist(), utf8(part.column(1))
        for a, b in blocks(texts):
            yield ids[a:b], Sets(texts[a:b], near), texts[a:b]


def sets_and_prints(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, unit, keys (none for an empty set), fp (with ``near.bits``) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s, texts in _read(batches, near):
            prints = np.array([simhash.fingerprint(t, near.shingle) for t in texts] if near.bits else [0] * len(texts), U).view(np.int64)
            keys = s.keys(near).view(np.int64).tolist()
            keys = [k if b > a else [] for k, a, b in zip(keys, s.cuts[:-1], s.cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s.unit.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(prints)], ["doc_id", "unit", "keys", "fp"])

    return docs.mapInArrow(run, "doc_id long, unit long, keys array<long>, fp long")


def units_of(rows: DataFrame) -> DataFrame:
    """unit, first_id, keys of each distinct set."""
    return rows.groupBy("unit").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"))


def key_groups(units: DataFrame) -> DataFrame:
    """group, n, leader, unit: the sets of units that share a key, each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def groups(key: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(first, append=len(key))
            group = mix(np.add.reduceat(mix(unit.view(U)), first)).view(np.int64)
            out = [np.repeat(x, size)[keep] for keep in [np.repeat(size > 1, size)] for x in (group, size, unit[first])]
            return pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(unit[np.repeat(size > 1, size)])], ["group", "n", "leader", "unit"])

        for batch in batches:
            key, unit = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([unit, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield groups(key[:cut], unit[:cut])
                key, unit = key[cut:], unit[cut:]
        if len(key):
            yield groups(key, unit)

    keyed = units.select(F.explode("keys").alias("key"), "unit")
    met = keyed.repartition(parallelism(units.sparkSession), "key").sortWithinPartitions("key", "unit")
    return met.mapInArrow(run, "group long, n long, leader long, unit long").distinct()


def sets_of(docs: DataFrame, groups: DataFrame, near: Near) -> DataFrame:
    """unit, shingles (packed) of the units of ``groups``."""
    n_units = groups.count()
    bits = buckets_for(n_units * 8, BUCKET_BYTES)

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = np.unique(batch.column(0).to_numpy().view(U))
            yield block_batch(list(to_blocks(u, [u], bits)))

    wanted, _ = build(groups.select("unit").mapInArrow(blocks_of, BLOCK), "wanted", bits, ["u8"], ["u8"], lambda a: ([np.unique(a[0])], []))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, _ in _read(batches, near):
            which = np.flatnonzero(shared.value.contains(s.unit))
            which = which[np.unique(s.unit[which], return_index=True)[1]]
            if len(which):
                yield pa.RecordBatch.from_arrays([pa.array(s.unit[which].view(np.int64)), pa.array([s.packed(i) for i in which], pa.binary())], ["unit", "shingles"])

    return docs.mapInArrow(run, "unit long, shingles binary").groupBy("unit").agg(F.first("shingles").alias("shingles"))


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / max(1, len(a) + len(b) - both)


def alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted arrays of distinct values have that Jaccard similarity."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both)


def _star_links(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            a, b, x, y = (c.to_pylist() for c in part.columns)
            keep = [alike(np.frombuffer(p, U), np.frombuffer(q, U), threshold) for p, q in zip(x, y, strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = groups.where("unit <> leader").select(F.col("leader").alias("a"), F.col("unit").alias("b")).distinct().withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    left = pairs.join(sets.select(F.col("unit").alias("b"), F.col("shingles").alias("y")), "b")
    right = pairs.select("a", "part").distinct().join(sets.select(F.col("unit").alias("a"), F.col("shingles").alias("x")), "a")
    return left.join(right, ["a", "part"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _group_links(groups: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members, found = None, [], []

        def links() -> pa.RecordBatch:
            edges = []
            if len(members) > 1:  # of each set the elements that are rarest in the group come first
                times = Counter(e for s in found for e in s)
                prefixes = [sorted(s, key=lambda e: (times[e], e))[: prefix_size(len(s), threshold)] for s in found]
                edges = cluster(members, prefixes, lambda i, j: jaccard(found[i], found[j]) >= threshold)
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

        for part in slices(batches):
            for group, unit, s in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if group != held:
                    yield links()
                    held, members, found = group, [], []
                members.append(unit)
                found.append(frozenset(np.frombuffer(s, U).tolist()))
        yield links()

    named = groups.where("n > 2").join(roots.select(F.col("node").alias("unit"), "root"), "unit", "left").select("group", "unit", F.coalesce("root", "unit").alias("root"))
    open_ = named.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("group")
    rest = named.join(open_, "group").select("group", "unit").join(sets, "unit").select("group", "unit", "shingles")
    return rest.repartition(parallelism(groups.sparkSession), "group").sortWithinPartitions("group", "unit").mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the smallest of their near-duplicate class."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(sets_and_prints(texts, near), "prints") if near.bits else sets_and_prints(texts, near)
    units = materialise(units_of(rows), "units")
    groups = materialise(key_groups(units), "groups")
    sets = materialise(sets_of(texts, groups, near), "sets")
    stars = _star_links(groups, sets, near.threshold)
    stars = materialise(stars.unionByName(print_links(rows)) if near.bits else stars, "stars")
    roots = materialise(components(stars), "roots")
    roots = components(stars.unionByName(_group_links(groups, roots, sets, near.threshold)))
    rooted = units.join(roots, units.unit == roots.node, "left").select("first_id", F.coalesce("root", "unit").alias("root"))  # combined where it lies
    kept = rooted.groupBy("root").agg(F.min("first_id").alias("_keep")).select("_keep").distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_keep"]), "left_semi")
