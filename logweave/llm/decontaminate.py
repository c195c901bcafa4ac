"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a run of ``seed_words`` words are compared by tiling:
the longest matches of unmarked words are found by running Karp-Rabin hashes, marked, and the search
goes on with shorter ones down to ``min_tile`` words. An item is found in a document if its tiles
cover at least ``threshold`` of its words, in whatever order they stand there.

Seeds are joined where the documents lie: the benchmark is cut into parts of at most ``part_bytes``
of text, each part is sent to all tasks in turn, and a larger benchmark means more passes over the
documents and not a larger broadcast. Documents are never shuffled (with more than one part only
their short findings are).

Defined results: words are runs of bytes outside ASCII white space, with A-Z lower-cased; null texts
count as empty; items with fewer than ``seed_words`` words cannot be told from chance and are never
found; of equally covered items the smallest item_id is named; repeated rows each get a row; extra
columns are ignored; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, utf8
from .words import U, blocks, shingle_hashes, word_hashes

_BASE = 0x2545F4914F6CDD1D


def _powers(n: int) -> np.ndarray:
    power = np.full(n, _BASE, U)
    power[:1] = 1
    np.multiply.accumulate(power, out=power)
    return power


def _window_hashes(x: np.ndarray, total: np.ndarray, power: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, running hash) of each window of ``size`` free positions; ``total`` are the running sums of x times ``power``."""
    if len(x) < size:
        return np.zeros(0, int), np.zeros(0, U)
    taken = np.concatenate([[0], np.cumsum(~free)])
    start = np.flatnonzero(taken[size:] == taken[:-size])
    return start, (total[start + size] - total[start]) * power[len(x) - 1 - start]  # brought to one common power


def tile(doc: np.ndarray, item: np.ndarray, free: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in doc, place in item, length) of two arrays of word hashes; only ``free`` places of doc take part."""
    free, left = free.copy(), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    size = len(item)
    # the hashes of both sides have the same scale because the item is laid after the document
    both = np.concatenate([doc, item])
    power = _powers(len(both))
    total = np.concatenate([np.zeros(1, U), np.cumsum(both * power)])
    while size >= min_tile:
        start, h = _window_hashes(both, total, power, np.concatenate([free, left]), size)
        in_doc = start + size <= len(doc)
        in_item = start >= len(doc)
        places: dict[int, list[int]] = {}
        for p, k in zip((start[in_item] - len(doc)).tolist(), h[in_item].tolist(), strict=True):
            places.setdefault(k, []).append(p)
        wanted = np.isin(h[in_doc], h[in_item])
        found: set[tuple[int, int, int]] = set()
        for d, k in zip(start[in_doc][wanted].tolist(), h[in_doc][wanted].tolist(), strict=True):
            for i in places[k]:
                if d and i and free[d - 1] and left[i - 1] and doc[d - 1] == item[i - 1]:
                    continue  # part of a longer match that starts before
                n = 0
                while d + n < len(doc) and i + n < len(item) and free[d + n] and left[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                if n >= size:
                    found.add((n, d, i))
        marked = False
        for n, d, i in sorted(found, key=lambda m: (-m[0], m[2], m[1])):
            if free[d : d + n].all() and left[i : i + n].all():
                free[d : d + n] = left[i : i + n] = False
                tiles.append((d, i, n))
                marked = True
        if not marked:
            size = min(size - 1, max(min_tile, size // 2)) if size > min_tile else 0
    return tiles


class Seeds:
    """The runs of ``n`` words of a part of the benchmark."""

    def __init__(self, ids: list, texts: list[bytes], n: int):
        h, first = word_hashes(texts)
        self.n = n
        self.items = [(i, h[a:b]) for i, a, b in zip(ids, first[:-1], first[1:], strict=True)]
        seeds, inside = shingle_hashes(h, first, n)
        owner = np.repeat(np.arange(len(ids)), np.diff(first))[inside]
        order = np.argsort(seeds[inside], kind="stable")
        self.seeds, self.owner = seeds[inside][order], owner[order]

    def find(self, texts: list[bytes], min_tile: int) -> list[list[tuple[object, float]]]:
        """For each text the items that share a seed with it and how much of each its tiles cover."""
        out: list[list[tuple[object, float]]] = [[] for _ in texts]
        if not len(self.seeds):
            return out
        h, first = word_hashes(texts)
        run, inside = shingle_hashes(h, first, self.n)
        at = np.flatnonzero(inside)
        lo = np.searchsorted(self.seeds, run[at])
        hit = self.seeds[np.minimum(lo, len(self.seeds) - 1)] == run[at]
        at, lo = at[hit], lo[hit]
        hi = np.searchsorted(self.seeds, run[at], side="right")
        pos = np.repeat(at, hi - lo)
        owner = self.owner[np.repeat(lo, hi - lo) + np.arange(len(pos)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        text = np.searchsorted(first, pos, side="right") - 1
        order = np.lexsort((pos, owner, text))
        pos, owner, text = pos[order], owner[order], text[order]
        edge = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        for a, b in zip(edge, np.append(edge, len(pos))[1:], strict=True):
            item_id, item = self.items[owner[a]]
            begin, end = first[text[a]], first[text[a] + 1]
            lo_at, hi_at = max(begin, pos[a] - len(item)), min(end, pos[b - 1] + len(item) + self.n)
            near = np.zeros(hi_at - lo_at + 1, np.int64)  # words within an item's length of a seed
            np.add.at(near, np.maximum(pos[a:b] - len(item), lo_at) - lo_at, 1)
            np.add.at(near, np.minimum(pos[a:b] + len(item) + self.n, hi_at) - lo_at, -1)
            free = np.cumsum(near)[:-1] > 0
            doc = h[lo_at:hi_at]
            free &= np.isin(doc, item)
            keep = free | np.concatenate([[False], free[:-1]])  # free words and one barrier after each run of them
            covered = sum(n for _, _, n in tile(doc[keep], item, free[keep], min_tile))
            out[text[a]].append((item_id, covered / len(item)))
        return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, seed_words: int = 5, min_tile: int = 3, part_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, contaminated, coverage (the largest), item_id (its item), item_ids (all over the threshold) of every row of ``docs``."""
    spark = docs.sparkSession
    item_type, doc_type = (df.schema[c].dataType.simpleString() for df, c in ((benchmark, "item_id"), (docs, "doc_id")))
    item_arrow = to_arrow_type(benchmark.schema["item_id"].dataType)
    size = benchmark.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    parts = int(size // part_bytes) + 1
    schema = f"doc_id {doc_type}, _row long, found array<struct<coverage:double,item_id:{item_type}>>"

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(*shared.value, seed_words)
            for batch in slices(batches):
                texts = utf8(batch.column(2))
                found: list[list[tuple[object, float]]] = []
                for a, b in blocks(texts):
                    found += seeds.find(texts[a:b], min_tile)
                over = [[{"coverage": c, "item_id": i} for i, c in f] for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(over, pa.list_(pa.struct([("coverage", pa.float64()), ("item_id", item_arrow)])))], ["doc_id", "_row", "found"])

        return run

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"), "text")
    scans = []
    for p in range(parts):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).select("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(([r.item_id for r in mine], [(r.text or "").encode() for r in mine]))
        scans.append(rows.mapInArrow(scan(shared), schema))
    found = scans[0]
    if parts > 1:  # every part has all rows; rows with the same id and text find the same
        each = reduce(DataFrame.unionByName, scans).groupBy("doc_id", "_row").agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"), (F.count("*") / parts).cast("int").alias("times"))
        found = each.select("doc_id", "found", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col")
    best = F.array_min(F.transform("found", lambda f: F.struct((-f["coverage"]).alias("less"), f["item_id"].alias("item_id"))))
    over = F.array_sort(F.transform(F.filter("found", lambda f: f["coverage"] >= threshold), lambda f: f["item_id"]))
    return found.select("doc_id", (F.size(over) > 0).alias("contaminated"), F.coalesce(-best["less"], F.lit(0.0)).alias("coverage"), best["item_id"].alias("item_id"), over.alias("item_ids"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose document holds no item."""
    bad = decontaminate(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
