"""SimHash near-duplicates: all pairs within two bits, found through Golay-code keys.

The 64 bits are cut into three segments of at most 23 bits. If two fingerprints differ in two bits
or fewer, some segment has no error (pigeonhole); the next segment has two or fewer. A 23-bit word
is decoded to the codewords of the binary Golay code within distance 4: one where a codeword lies
within 2, six otherwise. Two words that differ in at most two bits always share such a codeword:
the word midway lies within 3 of one (the code is perfect), so both lie within 4. A fingerprint
therefore gets a key (segment, its value, codeword of the next segment) for each of these, about 16
in all; fingerprints that share a key are compared exactly. Only distinct fingerprints take part,
so copies of a text never meet each other here.

Large runs of one key are not compared all with all: beyond ``PAIRWISE`` fingerprints each looks up
its 2,080 neighbours in the sorted run. A run gives a spanning forest of its links, and components
are found by distributed rounds.

Defined results: null texts count as empty; texts without words have fingerprint zero and link like
any other; shorter texts than a shingle are one shingle; repeated rows each get a row; a null doc_id
never names a component unless all are null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import and_end, join_counted, materialise, parallelism, slices, utf8
from .components import components, forest

U = np.uint64
SHIFTS, WIDTHS = (0, 22, 43), (22, 21, 21)
PAIRWISE = 1024
HOT = 1000


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of all runs of n words; a tie is 0."""
    line = b" ".join(text.lower().split())
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    f = xxhash.xxh64_intdigest
    if len(gaps) + 1 <= n:
        return f(line, seed)
    starts = [0, *(g + 1 for g in gaps[: len(gaps) - n + 1])]
    ends = [*gaps[n - 1 :], len(line)]
    hashes = np.array([f(line[s:e], seed) for s, e in zip(starts, ends, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65_536):
        part = hashes[a : a + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """fp and the ids of the documents of a batch that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list] = {}
            for part in slices(iter([batch])):
                for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True):
                    found.setdefault(fingerprint(text), []).append(doc_id)
            fps = np.array(list(found), U).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(list(found.values()), pa.list_(pa.int64()))], ["fp", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "fp long, ids array<long>")


def golay_patterns() -> tuple[np.ndarray, list[np.ndarray]]:
    """(syndrome of each single bit, for each syndrome the error patterns of weight 4 or less that have it)."""
    generator = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    bits = []
    for i in range(23):
        rest = 1 << i
        for k in range(22, 10, -1):
            if rest >> k & 1:
                rest ^= generator << (k - 11)
        bits.append(rest)
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for where in combinations(range(23), weight):
            s = e = 0
            for i in where:
                s, e = s ^ bits[i], e | 1 << i
            patterns[s].append(e)
    return np.array(bits, U), [np.array(p, U) for p in patterns]


class Golay:
    def __init__(self) -> None:
        bits, patterns = golay_patterns()
        self.most = max(map(len, patterns))
        self.n = np.array([len(p) for p in patterns])
        self.patterns = np.zeros((2048, self.most), U)
        for i, p in enumerate(patterns):
            self.patterns[i, : len(p)] = p
        part = lambda lo, n: np.bitwise_xor.reduce(np.where((np.arange(1 << n)[:, None] >> np.arange(n)) & 1, bits[lo : lo + n].astype(np.int64), 0), axis=1)
        self.low, self.high = part(0, 12), part(12, 11)

    def codewords(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index of a codeword within distance 4) for each such codeword of each 23-bit word."""
        s = self.low[(v & U(4095)).astype(np.int64)] ^ self.high[(v >> U(12)).astype(np.int64)]
        row = np.repeat(np.arange(len(v)), self.n[s])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(self.n[s]) - self.n[s], self.n[s])
        return row, (v[row] ^ self.patterns[s[row], nth]) >> U(11)  # the code is systematic in its upper 12 bits


def keys_of(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) pairs; any two fingerprints within two bits share a key."""
    keys, rows = [], []
    seg = [(fp >> U(s)) & U((1 << w) - 1) for s, w in zip(SHIFTS, WIDTHS, strict=True)]
    for i in range(3):
        row, word = golay.codewords(seg[(i + 1) % 3])
        keys.append(U(i) << U(40) | seg[i][row] << U(12) | word)
        rows.append(fp[row])
    return np.concatenate(keys), np.concatenate(rows)


_MASKS = np.array([1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)], U)


def links(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within two bits of a sorted run of distinct fingerprints."""
    a, b = [np.zeros(0, U)], [np.zeros(0, U)]
    if len(run) <= PAIRWISE:
        for i in range(len(run) - 1):
            near = run[i + 1 :][np.bitwise_count(run[i + 1 :] ^ run[i]) <= 2]
            a.append(np.full(len(near), run[i]))
            b.append(near)
    else:
        for mask in _MASKS:
            other = run ^ mask
            hit = (run[np.minimum(np.searchsorted(run, other), len(run) - 1)] == other) & (other > run)
            a.append(run[hit])
            b.append(other[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    return forest(a, b) if len(a) else (a, b)


def near_links(distinct: DataFrame) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) whose components are those of all pairs within two bits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            key, fp = keys_of(batch.column(0).to_numpy().view(U), golay)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in and_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U)))
                if held[0][0][0] == held[-1][0][-1]:  # one key so far: joined when it ends
                    continue
            if not held:
                continue
            key, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            cuts = np.concatenate([[0], edge, [len(key)]]) if batch is None else np.concatenate([[0], edge])
            a, b = [np.zeros(0, U)], [np.zeros(0, U)]
            for i in np.flatnonzero(np.diff(cuts) > 1):
                x, y = links(np.unique(fp[cuts[i] : cuts[i + 1]]))
                a.append(x)
                b.append(y)
            held = [(key[cuts[-1] :], fp[cuts[-1] :])] if cuts[-1] < len(key) else []
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

    keyed = distinct.select("fp").mapInArrow(emit, "key long, fp long")
    return keyed.repartition(parallelism(distinct.sparkSession), "key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")


def simhash_classes(docs: DataFrame, hot_rows: int = 8) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and component_id of every row of ``docs``."""
    prints = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min(F.array_min("ids")).alias("first_id"), F.count("*").alias("n")), "distinct")
    roots = components(near_links(distinct))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", "root")
    joined = distinct.join(roots.select("root").distinct(), distinct.fp == F.col("root"), "left_semi")
    linked = rooted.where("root is not null").unionByName(joined.select("fp", "first_id", F.col("fp").alias("root")))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    named = join_counted(linked, least, ["root"], "n", linked.count()).select("fp", "component_id")
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n")
    # fingerprints with a thousandth of all rows or more are at most HOT; they are sent to their rows, which stay spread out
    least = max(hot_rows, prints.count() // HOT + 1)
    hot = F.broadcast(classes.where(F.col("n") >= least).select("fp", F.struct("component_id").alias("known")))
    marked = prints.join(hot, "fp", "left")
    cold = marked.where("known IS NULL").drop("known").join(classes.where(F.col("n") < least).drop("n"), "fp")
    rows = marked.where("known IS NOT NULL").select("ids", "fp", "known.component_id").unionByName(cold)
    return rows.select(F.explode("ids").alias("doc_id"), "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id names their near-duplicate class."""
    kept = simhash_classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_keep"]), "left_semi")
