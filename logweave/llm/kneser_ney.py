"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, scored from memory-mapped sorted arrays.

Three passes over the texts, all over packed numpy blocks (a row for each task and bucket, not for
each n-gram):

1. word counts of the training texts give the vocabulary store (word hash, count); a word's place in
   it is its id;
2. n-grams of ids, combined in each task, meet in buckets by their context, where they are counted
   and the context's total and its numbers of successors seen once, twice and more often are found.
   What follows for the next lower order (each distinct n-gram counts once for its suffix) leaves
   the bucket in packed blocks again;
3. texts are scored where they lie: workers map the stores and look up sorted unique keys.

A context all of whose words are frequent (over ``hot_share`` of all tokens, so at most
1 / hot_share words) would crowd one bucket: its n-grams are dealt by their own hash instead, and
the few sums that its buckets find are added up on the driver.

Probabilities: the highest order uses counts, lower orders the numbers of distinct left neighbours;
discounts D1, D2, D3+ come from the counts of counts of each order; the lowest order is interpolated
with 1 / (V + 1), which an unknown word gets alone. Texts start with order - 1 start marks.

Defined results: null texts count as empty; an empty text is its end token; with nothing to learn
from every token has probability 1; repeated rows each get a row (and each count in training); extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch, slices, utf8
from .hashstore import BLOCK, Store, block_batch, bucket_of, buckets_for, build, pack, sum_by_key, to_blocks, unpack, write_array
from .words import U, blocks, join_hash, mix, word_hashes

END = U(0x5851F42D4C957F2D)
BUCKET_BYTES = 24 << 20


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end token after each text, and the first place of each text + total."""
    h, first = word_hashes(texts)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def windows(ids: np.ndarray, first: np.ndarray, n: int, start: int) -> list[np.ndarray]:
    """The n columns of the n-grams that end at each token; ``start`` fills in before a text."""
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    return [np.where(place >= back, np.roll(ids, back), ids.dtype.type(start)) if back else ids for back in range(n - 1, -1, -1)]


def context_key(columns: list[np.ndarray]) -> np.ndarray:
    key = mix(columns[0].astype(U) + U(1))
    for c in columns[1:]:
        key = join_hash(key, c.astype(U) + U(1))
    return key


def gram_key(context: np.ndarray, last: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A key that lies in its context's bucket, unless the context is hot."""
    own = join_hash(context, last.astype(U) + U(1))
    return np.where(hot, own, context & ~U((1 << 40) - 1) | own & U((1 << 40) - 1))


@dataclass
class Order:
    grams: Store  # key, count
    contexts: Store  # key, total, seen once, twice, more often
    hot: dict[int, tuple[int, int, int, int]]  # the same of hot contexts
    discounts: tuple[float, float, float]


@dataclass
class Model:
    order: int
    vocabulary: Store  # word hash, count
    offsets: dict[int, int]
    total: int  # N, training tokens
    hot_ids: np.ndarray
    left: Store | None = None  # word id key, number of distinct left neighbours
    left_total: int = 0
    left_seen: tuple[int, int, int] = (0, 0, 0)
    left_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    orders: tuple[Order, ...] = ()  # from 2 upwards

    @property
    def size(self) -> int:
        return self.vocabulary.n

    @property
    def start(self) -> int:
        return self.size

    @property
    def id_type(self) -> str:
        return "u4" if self.size < (1 << 32) - 2 else "u8"

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each word hash; an unknown word has id size + 1 and count 0."""
        kinds, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(kinds), self.size + 1, self.id_type), np.zeros(len(kinds), np.int64)
        bucket = bucket_of(kinds, self.vocabulary.bits)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(kinds)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            keys, n = self.vocabulary.bucket(int(bucket[a]))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, kinds[a:b]), len(keys) - 1)
                hit = keys[at] == kinds[a:b]
                ids[a:b][hit] = at[hit] + self.offsets[int(bucket[a])]
                counts[a:b][hit] = n[at[hit]]
        return ids[back], counts[back]

    def is_hot(self, context: list[np.ndarray]) -> np.ndarray:
        hot = np.ones(len(context[0]), bool)
        for c in context:
            hot &= (self.hot_ids[np.minimum(np.searchsorted(self.hot_ids, c), len(self.hot_ids) - 1)] == c) if len(self.hot_ids) else False
        return hot

    def log10(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        p = np.full(len(ids), 1 / (self.size + 1))
        if self.left_total:
            (left,) = self.left.lookup(mix(ids.astype(U) + U(1)), [1])
            gamma = sum(d * n for d, n in zip(self.left_discounts, self.left_seen, strict=True)) / self.left_total
            p = (left - _discount(left, self.left_discounts)) / self.left_total + gamma * p
        columns = windows(ids, first, self.order, self.start)
        for n, order in enumerate(self.orders, 2):
            context, last = columns[self.order - n : -1], columns[-1]
            hot = self.is_hot(context)
            key = context_key(context)
            total, one, two, more = order.contexts.lookup(key, [1, 2, 3, 4])
            if order.hot and hot.any():
                known = np.array(sorted(order.hot), U)
                values = np.array([order.hot[int(k)] for k in known], np.int64)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                use = hot & (known[at] == key)
                for column, v in zip((total, one, two, more), values.T, strict=True):
                    column[use] = v[at[use]]
            (count,) = order.grams.lookup(gram_key(key, last, hot), [1])
            seen = total > 0
            t = np.maximum(total, 1)
            d1, d2, d3 = order.discounts
            p = np.where(seen, (count - _discount(count, order.discounts)) / t + (d1 * one + d2 * two + d3 * more) / t * p, p)
        return np.log10(p)


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3).astype(np.int64)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of entries counted once to four times; tiny samples fall back to 0.5, 1, 1.5."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    clip = lambda d, most: float(min(max(d, 0.05 * most), most))
    return clip(1 - 2 * y * n2 / n1, 1.0), clip(2 - 3 * y * n3 / n2, 2.0), clip(3 - 4 * y * n4 / n3, 3.0)


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _texts(column: DataFrame, run) -> DataFrame:
    return column.select("text").mapInArrow(run, BLOCK)


def _combined(batches: Iterator[pa.RecordBatch], of, bits: int, limit: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Blocks of the keys and columns that ``of`` makes of texts, summed by key over up to ``limit`` entries."""
    held: list[list[np.ndarray]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        first = np.flatnonzero(np.diff(columns[0][order], prepend=~columns[0][order[0]]))
        counts = np.diff(first, append=len(order)).astype("u4")
        columns = [c[order[first]] for c in columns]
        held.clear()
        return block_batch(list(to_blocks(columns[0], [*columns[1:], counts], bits)))

    for batch in slices(batches):
        texts = utf8(batch.column(0))
        for a, b in blocks(texts):
            held.append(of(texts[a:b]))
            n += len(held[-1][0])
            if n >= limit:
                yield flush()
                n = 0
    if n:
        yield flush()


def fit(training: DataFrame, order: int = 2, hot_share: float = 1 / 256) -> Model:
    """Learn from the column text of every row."""
    n_bytes = training.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    word_bits, gram_bits = buckets_for(n_bytes // 12, BUCKET_BYTES), buckets_for(n_bytes * (order + 1) // 2, BUCKET_BYTES)

    def words_of(texts: list[bytes]) -> list[np.ndarray]:
        h, _ = tokens(texts)
        return [h, h]

    def merge_words(arrays: list[np.ndarray]):
        keys, n = sum_by_key(arrays[0], arrays[1].astype(np.int64))
        return [keys, n], [n.sum()]

    vocabulary, (total,) = build(_texts(training, lambda batches: _combined(batches, words_of, word_bits)), "words", word_bits, ["u8", "u4"], ["u8", "i8"], merge_words, 1) if n_bytes else (Store("", word_bits, ["u8", "i8"], {}), [0])
    offsets, at = {}, 0
    for b in sorted(vocabulary.sizes):
        offsets[b], at = at, at + vocabulary.sizes[b]
    model = Model(order, vocabulary, offsets, total, np.zeros(0, U))
    if not total:
        return model
    model.hot_ids = _hot(training.sparkSession, model, hot_share)
    shared = training.sparkSession.sparkContext.broadcast(model)

    def grams_of(texts: list[bytes]) -> list[np.ndarray]:
        m = shared.value
        h, first = tokens(texts)
        columns = windows(m.ids(h)[0], first, order, m.start)
        return [gram_key(context_key(columns[:-1]), columns[-1], m.is_hot(columns[:-1])), *columns]

    rows = _texts(training, lambda batches: _combined(batches, grams_of, gram_bits))
    orders = []
    for n in range(order, 1, -1):
        level, rows = _count_order(rows, n, shared, gram_bits, word_bits)
        orders.insert(0, level)

    def merge_left(arrays: list[np.ndarray]):
        keys, left = sum_by_key(mix(arrays[0].astype(U) + U(1)), arrays[1].astype(np.int64))
        return [keys, left], [left.sum(), len(left), *_counts_of_counts(left)]

    model.left, (model.left_total, kinds, *n) = build(rows, "left", word_bits, [model.id_type, "u4"], ["u8", "i8"], merge_left, 6)
    model.left_seen, model.left_discounts = (n[0], n[1], kinds - n[0] - n[1]), discounts(n)
    model.orders = tuple(orders)
    return model


def _hot(spark, model: Model, share: float) -> np.ndarray:
    """Ids of the words with more than ``share`` of all tokens, and of the start mark; read bucket by bucket by tasks."""
    least = share * model.total
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in batch.column(0).to_pylist():
                found = np.flatnonzero(np.asarray(m.vocabulary.bucket(b)[1]) > least) + m.offsets[b]
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["id"])

    numbers = spark.createDataFrame([(b,) for b in model.vocabulary.sizes], "bucket int")
    return np.array(sorted([r.id for r in numbers.mapInArrow(run, "id long").collect()] + [model.start]), U)


def _count_order(rows: DataFrame, n: int, shared, bits: int, word_bits: int) -> tuple[Order, DataFrame]:
    """Count the n-grams of packed blocks (n id columns, counts); gives the order and the blocks of the next lower one."""
    spark = rows.sparkSession
    id_type = shared.value.id_type
    gram_folder, context_folder = scratch(spark, f"grams{n}"), scratch(spark, f"contexts{n}")

    def reduce(key, table):
        m = shared.value
        parts = [unpack(p.as_py(), [*[id_type] * n, "u4"]) for p in table.column("payload")]
        *ids, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        hot = m.is_hot(ids[:-1])
        context = context_key(ids[:-1])
        grams = gram_key(context, ids[-1], hot)
        order = np.argsort(grams, kind="stable")
        first = np.flatnonzero(np.diff(grams[order], prepend=~grams[order[0]]))
        count = np.add.reduceat(counts[order].astype(np.int64), first)
        at = order[first]
        grams, context, hot, ids = grams[at], context[at], hot[at], [c[at] for c in ids]
        bucket = key[0].as_py()
        write_array(gram_folder, str(bucket), [grams, np.minimum(count, (1 << 32) - 1).astype("u4")])
        stats = sum_by_key(context, count, *((count == k).astype(np.int64) for k in (1, 2)), (count > 2).astype(np.int64), hot.astype(np.int64))
        cold = stats[-1] == 0
        write_array(context_folder, str(bucket), [stats[0][cold], *(s[cold] for s in stats[1:5])])
        if n > 2:
            suffix = ids[1:]
            lower = gram_key(context_key(suffix[:-1]), suffix[-1], m.is_hot(suffix[:-1]))
        else:
            suffix, lower = ids[1:], mix(ids[1].astype(U) + U(1))
        order = np.argsort(lower, kind="stable")
        first = np.flatnonzero(np.diff(lower[order], prepend=~lower[order[0]]))
        times = np.diff(first, append=len(order)).astype("u4")
        out = list(to_blocks(lower[order[first]], [*(c[order[first]] for c in suffix), times], bits if n > 2 else word_bits))
        found = [len(grams), int(cold.sum()), *_counts_of_counts(count)]
        hots = pack([np.concatenate([s[~cold].astype(np.int64) if i else s[~cold].view(np.int64) for i, s in enumerate(stats[:5])])])
        return pa.table({"bucket": pa.array([b for b, _ in out] + [bucket], pa.int32()), "payload": pa.array([p for _, p in out] + [hots], pa.binary()), "stats": pa.array([None] * len(out) + [found], pa.list_(pa.int64()))})

    done = materialise(rows.groupBy("bucket").applyInArrow(reduce, f"{BLOCK}, stats array<long>"), f"order{n}")
    stats = done.where("stats is not null").collect()  # one row a bucket, with its share of the hot contexts
    hot: dict[int, np.ndarray] = {}
    for r in stats:
        for k, *values in np.frombuffer(bytes(r.payload), np.int64).reshape(5, -1).T.tolist():
            hot[k & (1 << 64) - 1] = hot.get(k & (1 << 64) - 1, np.zeros(4, np.int64)) + values
    stores = []
    for i, (folder, dtypes) in enumerate(((gram_folder, ["u8", "u4"]), (context_folder, ["u8", *["i8"] * 4]))):
        stores.append(Store(folder, bits, dtypes, {r.bucket: r.stats[i] for r in stats if r.stats[i]}).fetch(spark))
    return Order(*stores, {k: tuple(map(int, v)) for k, v in hot.items()}, discounts([sum(r.stats[i] for r in stats) for i in range(2, 6)])), done.where("stats is null").select("bucket", "payload")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 1000):
            texts = utf8(batch.column(1))
            for a, b in blocks(texts, 4 << 20):
                h, first = tokens(texts[a:b])
                ids, counts = m.ids(h)
                base = np.log10((counts + 0.5) / (m.total + 0.5 * (m.size + 1)))
                n = b - a
                columns = [np.diff(first), np.add.reduceat(counts > 0, first[:-1], dtype=np.int64), np.full(n, m.total), np.add.reduceat(base, first[:-1]), np.add.reduceat(m.log10(ids, first), first[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
