"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers.

A store is cut into buckets by the top bits of its 64-bit keys, so the buckets in turn are one
sorted array. Tasks send packed blocks of keys to the buckets (a row per task and bucket, never a
row per key); a bucket's task merges them and writes its arrays under a name that its content
decides, by writing aside and renaming, so a task that runs twice leaves the same file. Workers map
the files of a bucket when a key first falls into it; the pages belong to the file cache and not to
the worker. Where the shared folder is no mounted file system, files are written through pyarrow's
file systems and fetched with SparkFiles.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

U = np.uint64
BLOCK = "bucket int, payload binary"


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def pack(arrays: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(payload: bytes, dtypes: list[str]) -> list[np.ndarray]:
    n = len(payload) // sum(np.dtype(d).itemsize for d in dtypes)
    out, at = [], 0
    for d in dtypes:
        out.append(np.frombuffer(payload, d, n, at))
        at += n * np.dtype(d).itemsize
    return out


def to_blocks(keys: np.ndarray, arrays: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed arrays) of sorted keys."""
    bucket = bucket_of(keys, bits)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(keys)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(bucket[a]), pack([x[a:b] for x in arrays])


def block_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["bucket", "payload"])


def sum_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))


def write_array(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    for i, a in enumerate(arrays):
        aside = f"{path}/.{name}.{i}.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as out:
            out.write(np.ascontiguousarray(a).tobytes())
        fs.move(aside, f"{path}/{name}.{i}")


@dataclass
class Store:
    """``sizes``: entries of each bucket that has any (one number a bucket, so small)."""

    folder: str
    bits: int
    dtypes: list[str]
    sizes: dict[int, int]
    fetched: str | None = None
    _maps: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    @property
    def n(self) -> int:
        return sum(self.sizes.values())

    def fetch(self, spark) -> Store:
        """Where the folder is no mounted one, hand its files to the executors."""
        if not self.folder.startswith("file:"):
            self.fetched = self.folder.rsplit("/", 1)[1]
            spark.sparkContext.addFile(self.folder, recursive=True)
        return self

    def bucket(self, b: int) -> list[np.ndarray]:
        if b not in self._maps:
            if n := self.sizes.get(b, 0):
                root = SparkFiles.get(self.fetched) if self.fetched else pafs.FileSystem.from_uri(self.folder)[1]
                self._maps[b] = [np.memmap(os.path.join(root, f"{b}.{i}"), d, "r", shape=(n,)) for i, d in enumerate(self.dtypes)]
            else:
                self._maps[b] = [np.zeros(0, d) for d in self.dtypes]
        return self._maps[b]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        kinds, back = np.unique(keys, return_inverse=True)
        found = np.zeros(len(kinds), bool)
        bucket = bucket_of(kinds, self.bits)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(kinds)]]) if len(kinds) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            have = self.bucket(int(bucket[a]))[0]
            if len(have):
                found[a:b] = have[np.minimum(np.searchsorted(have, kinds[a:b]), len(have) - 1)] == kinds[a:b]
        return found[back]

    def find(self, keys: np.ndarray, want: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each key is there, and its entries of the arrays ``want`` (by number), zero where it is missing."""
        if not len(keys):
            return np.zeros(0, bool), [np.zeros(0, self.dtypes[w]) for w in want]
        kinds, back = np.unique(keys, return_inverse=True)
        there = np.zeros(len(kinds), bool)
        found = [np.zeros(len(kinds), self.dtypes[w]) for w in want]
        bucket = bucket_of(kinds, self.bits)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(kinds)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            arrays = self.bucket(int(bucket[a]))
            if len(arrays[0]):
                at = np.minimum(np.searchsorted(arrays[0], kinds[a:b]), len(arrays[0]) - 1)
                hit = arrays[0][at] == kinds[a:b]
                there[a:b] = hit
                for x, w in zip(found, want, strict=True):
                    x[a:b][hit] = arrays[w][at[hit]]
        return there[back], [x[back] for x in found]

    def lookup(self, keys: np.ndarray, want: list[int]) -> list[np.ndarray]:
        """For each key the entries of the arrays ``want`` (by number), zero where the key is missing."""
        return self.find(keys, want)[1]


def buckets_for(n_bytes: int, bucket_bytes: int) -> int:
    """Bits of the bucket number for about ``bucket_bytes`` in each."""
    bits = 3
    while bits < 20 and n_bytes >> bits > bucket_bytes:
        bits += 1
    return bits


def build(blocks: DataFrame, name: str, bits: int, dtypes_in: list[str], dtypes_out: list[str], merge: Callable[[list[np.ndarray]], tuple[list[np.ndarray], list[int]]], n_stats: int = 0) -> tuple[Store, list[int]]:
    """Merge packed blocks bucket by bucket and write the arrays.

    ``merge`` gets the concatenated arrays of a bucket and returns (arrays to write, keys first and sorted; ``n_stats``
    integers that are added up over the buckets).
    """
    spark = blocks.sparkSession
    folder = scratch(spark, name)
    stats = [f"s{i}" for i in range(n_stats)]

    def reduce(key, table):
        parts = [unpack(p.as_py(), dtypes_in) for p in table.column("payload")]
        arrays = [np.concatenate(c) for c in zip(*parts, strict=True)]
        del parts
        out, sums = merge(arrays)
        bucket = key[0].as_py()
        if len(out[0]):
            write_array(folder, str(bucket), [a.astype(d, copy=False) for a, d in zip(out, dtypes_out, strict=True)])
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(out[0])], pa.int64())} | {k: pa.array([int(s)], pa.int64()) for k, s in zip(stats, sums, strict=True)})

    schema = "bucket int, n long" + "".join(f", {s} long" for s in stats)
    rows = blocks.groupBy("bucket").applyInArrow(reduce, schema).collect()  # one row a bucket
    store = Store(folder, bits, dtypes_out, {r.bucket: r.n for r in rows if r.n}).fetch(spark)
    return store, [sum(r[2 + i] for r in rows) for i in range(n_stats)]
