"""Repeated passages across documents: MinHash sketches of content-anchored paragraphs.

Passages that documents share seldom begin where a line does, so paragraphs are cut by content: a
word is an anchor if the hash of the two words from it is the smallest in some window of ``window``
words, and from each anchor ``words`` words are a paragraph. Any passage of ``window + words - 1``
words (45) that two documents share holds one paragraph that both have, wherever it stands. A text
of fewer than ``words`` words, but at least ``least``, is one paragraph.

Two paragraphs are similar if their edit distance in words is at most 1 - ``threshold`` of the longer
(6 of 30). Jaccard similarity of their 5-word shingles would lose a passage for one changed word in
its middle; edit distance doesn't. An edit changes at most three of a paragraph's 3-word shingles, so two
similar paragraphs of 30 words share at least 10 of 28. Bands of several MinHash values would lose pairs
with that many edits, so each value is a band of its own, and as many are taken as lose none: the 19 smallest
of the 28 (a bottom-k sketch) of one paragraph and those of the other have one in common, whatever the order
(``Shape.sketches``; one edit of five words leaves no 3-word shingle, so such texts have 2-word ones too).

1. The shingles that two or more rows have are gathered (packed arrays, a row for each task and bucket) into
   a sorted array, with how frequent they are. The order of the sketches is by that, then by hash: rare
   shingles first. A paragraph with fewer than 10 such shingles has no similar one in another document.
2. The other paragraphs leave (hash, smallest and largest document) and (key and place, hash) pairs, one for
   each such shingle of the sketch. Equal paragraphs need no more. A word that stays moves by half the edits
   at most (``Shape.reach``), so those with a key at far places, such as paragraphs of one text that overlap,
   need no comparison by it: a key's paragraphs in order of place are cut where the next is farther away. What
   is left of different paragraphs are the candidate groups.
   Those of more than ``FEW`` are cut into windows of places that overlap, but for keys that a paragraph repeats.
3. Only for those the words are fetched, into a sorted array where the groups' tasks look them up (``unite``).
   All pairs of a small group are compared, a bit mask of their words first. In a larger one each paragraph is
   first compared with one of the group, and where that leaves more than one component, the rarest words are
   keys of their own. A group of more than ``GROUP`` is no task's work as a whole: there the same is done by
   pairs and keys dealt to tasks.
4. Linked paragraphs form components (``component_store``). Of each component the smallest doc_id keeps its paragraphs; the
   other documents lose theirs. The verdicts are a sorted array too: each document looks its own
   paragraphs up where it lies, so no passage is ever a join key.

Defined results: words are runs of bytes outside ASCII white space, A-Z lower-cased; null texts count
as empty; documents are told apart by doc_id (a null one is the largest), so rows that repeat an id
never count as repeats of each other; repeats within one document stay; texts of fewer than ``least``
words have no paragraph; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import and_end, drop_scratch, free_shuffles, give_back, join_counted, materialise, parallelism, scratch, slices, utf8
from .components import component_store, components, edge_blocks, forest
from .hashstore import BLOCK, Store, block_batch, buckets_for, build, sum_by_key, to_blocks, unpack, write_array
from .words import U, blocks, join_hash, mix, shingle_hashes, word_hashes

NULL_ID = (1 << 63) - 1
BUCKET_BYTES = 12 << 20
#: Paragraphs of a group that one task compares.
GROUP = 10_000
#: Paragraphs of a group whose pairs are all compared.
FEW = 32
#: The place of a key that a paragraph has in ``OFTEN`` places or more.
ANYWHERE, OFTEN = 0xFFFF, 4
#: Of a word's hash as many bytes are compared: two different ones of a pair agree with a chance of 1 in 10**12.
WORD_BYTES = 5


def tune_bands(threshold: float, recall: float, max_hashes: int = 32) -> tuple[int, int]:
    """(bands, rows) with the most rows a band, then the fewest bands, that reach the recall at the threshold."""
    best = (1, 1)
    for rows in range(1, max_hashes + 1):
        for bands in range(1, max_hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of ``width`` values (shorter by width - 1)."""
    done = 1
    while done * 2 <= width:
        x = f(x[: len(x) - done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def edits(n: int, threshold: float) -> int:
    """How many words of the longer of two similar paragraphs, of n words, are changed, added or dropped at most."""
    return int((1 - threshold) * n + 1e-9)


@dataclass(frozen=True)
class Shape:
    words: int = 30
    window: int = 16
    anchor: int = 2
    shingle: int = 3  # of keys
    least: int = 5  # words of the shortest text that is a paragraph
    threshold: float = 0.8

    def sketches(self, n: int) -> dict[int, int]:
        """For a paragraph of n words: length of a shingle -> how many a similar paragraph shares at the least.

        An edit changes at most q shingles of q words, so paragraphs k edits apart, the longer of m words, share
        m - q + 1 - k * q. Where that is none (one edit in 5 words), shorter shingles serve.
        """
        out: dict[int, int] = {}
        for m in range(n, self.words + 1):
            k = edits(m, self.threshold)
            if m - n > k:
                break
            q = max(q for q in range(1, self.shingle + 1) if q == 1 or m - q + 1 - k * q > 0)
            out[q] = min(out.get(q, m), max(1, m - q + 1 - k * q))
        return out

    @property
    def reach(self) -> int:
        """How far apart the places of a shingle that two similar paragraphs share are at most.

        A place is the number of words before less that of words from there on. The edits before a word that stays change
        the one number by as many at most, those behind it the other.
        """
        return edits(self.words, self.threshold)


class Paragraphs:
    """The paragraphs of a block of texts: ``at`` first words, ``size`` numbers of words, ``text`` their texts, ``unit`` hashes
    of their words. Those of short texts come last (from ``long`` on)."""

    def __init__(self, texts: list[bytes], shape: Shape):
        self.shape = shape
        self._shingles: dict[int, np.ndarray] = {}
        h, self.first = word_hashes(texts)
        self.h = h
        n, w = shape.words, shape.window
        sizes = np.diff(self.first)
        at = np.zeros(0, int)
        if len(h) >= max(n, w):
            rank = mix(shingle_hashes(h, self.first, shape.anchor)[0] ^ U(0x1F83D9ABFB41BD6B))
            lowest = _slide(rank, w, np.minimum)  # of the window that starts here
            ends = np.repeat(self.first[1:], sizes)
            places = np.arange(len(h))
            lowest = np.where(places[: len(lowest)] + w <= ends[: len(lowest)], lowest, U(0))  # windows stay in a text
            padded = np.concatenate([np.zeros(w - 1, U), lowest, np.zeros(w - 1, U)])
            anchor = _slide(padded, w, np.maximum)[: len(h)] == rank
            at = np.flatnonzero(anchor & (places + n <= ends))
        short = np.flatnonzero((sizes >= shape.least) & (sizes < n))
        self.long = len(at)
        self.at = np.concatenate([at, self.first[short]])
        self.size = np.concatenate([np.full(len(at), n), sizes[short]])
        self.text = np.concatenate([np.searchsorted(self.first, at, side="right") - 1, short])
        self.unit = np.zeros(len(self.at), U)
        if self.long:
            self.unit[: self.long] = _slide(h, n, join_hash)[at]
        self.unit[self.long :] = self._each(h, self.size[self.long :], lambda a, b: mix(a * U(3) + b))
    def _each(self, x: np.ndarray, counts: np.ndarray, f) -> np.ndarray:
        """f over the ``counts`` values of x from the start of each short paragraph on."""
        at = self.at[self.long :]
        out = x[at].copy()
        for k in range(1, int(counts.max(initial=1))):
            more = counts > k
            out[more] = f(out[more], x[at[more] + k])
        return out

    def by_size(self) -> Iterator[tuple[np.ndarray, int, int, int]]:
        """(paragraphs, their words, length of shingles, how many of these a similar one shares) for each kind of sketch."""
        for n in np.unique(self.size).tolist():
            which = np.arange(self.long) if n == self.shape.words else self.long + np.flatnonzero(self.size[self.long :] == n)
            for q, shared in self.shape.sketches(n).items():
                yield which, n, q, shared

    def shingles(self, q: int) -> np.ndarray:
        """The shingle of q words from each word on, as a key: 48 bits, told from those of other lengths."""
        if q not in self._shingles:
            keys = shingle_hashes(self.h, self.first, q)[0]
            self._shingles[q] = (keys if q == self.shape.shingle else join_hash(keys, np.array([q], U))) & ~U(0xFFFF)
        return self._shingles[q]

    def places(self) -> Iterator[tuple[int, np.ndarray]]:
        """(length of shingles, first words of those that paragraphs hold), in turn."""
        held: dict[int, np.ndarray] = {}
        for which, n, q, _ in self.by_size():
            mark = held.setdefault(q, np.zeros(len(self.h) + 1, np.int64))
            mark[self.at[which]] += 1
            mark[self.at[which] + n - q + 1] -= 1
        for q, mark in held.items():
            yield q, np.flatnonzero(np.cumsum(mark[:-1]))

    def keys(self) -> np.ndarray:
        """All shingles of each paragraph: a row for each, filled up with its first."""
        out = np.zeros((len(self.at), 0), U)
        for which, n, q, _ in self.by_size():
            more = np.zeros((len(self.at), n - q + 1), U)
            more[which] = self.shingles(q)[self.at[which, None] + np.arange(n - q + 1)]
            out = np.concatenate([out, more], axis=1)
        return np.where(out == 0, out.max(axis=1, keepdims=True, initial=0), out)

    def sketch(self, kind: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, key and place) of the MinHash sketches: of the shingles, in one order for all paragraphs, the smallest ones.

        ``kind``: for each place how frequent its shingle is, 0 if one document has it; rarer ones are smaller. Of N
        shingles, ``shared`` in common, two paragraphs share one of the N - shared + 1 smallest, those equal to the last of
        them included. One with fewer than ``shared`` that other documents have is similar to none there. The low 16 bits
        tell the place, from 0 on (``Shape.reach``), or ``ANYWHERE``.
        """
        rows, keys = [np.zeros(0, int)], [np.zeros(0, U)]
        for which, n, q, shared in self.by_size():
            nth = np.arange(n - q + 1)
            often = kind[q][self.at[which, None] + nth]
            some = np.flatnonzero((often > 0).sum(axis=1) >= shared)
            often, values = often[some], self.shingles(q)[self.at[which[some], None] + nth]
            order = often.astype(U) << U(48) | values >> U(16)
            place = np.repeat((2 * nth - n + self.shape.words).astype(U)[None], len(some), axis=0)
            ranks = np.sort(order, axis=1)
            again = np.flatnonzero(np.count_nonzero(ranks[:, 1:] == ranks[:, :-1], axis=1) >= OFTEN - 1)
            place[again] = np.where(sum((order[again] == order[again, i : i + 1]).astype(np.uint8) for i in range(n - q + 1)) >= OFTEN, U(ANYWHERE), place[again])
            row, col = np.nonzero((order <= ranks[:, n - q + 1 - shared, None]) & (often > 0))
            rows.append(which[some][row])
            keys.append(values[row, col] | place[row, col])
        return np.concatenate(rows), np.concatenate(keys)

    def packed(self, which: np.ndarray) -> np.ndarray:
        """The words of paragraphs, WORD_BYTES bytes of each hash, filled up with zeros."""
        nth = np.arange(self.shape.words)
        inside = nth < self.size[which, None]
        at = np.where(inside, self.at[which, None] + nth, 0)
        words = self.h.view(np.uint8).reshape(-1, 8)[:, -WORD_BYTES:][at] * inside[:, :, None]
        return np.ascontiguousarray(words).reshape(len(which), -1).view(f"V{WORD_BYTES * self.shape.words}").ravel()


def words_of(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + WORD_BYTES], "little") for i in range(0, len(data), WORD_BYTES)]


def word_lists(packed: list[bytes]) -> list[list[int]]:
    """``words_of`` of each."""
    wide = np.zeros((sum(map(len, packed)) // WORD_BYTES, 8), np.uint8)
    wide[:, :WORD_BYTES] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, WORD_BYTES)
    values = wide.view("<u8").ravel().tolist()
    cuts = np.cumsum([0, *(len(p) // WORD_BYTES for p in packed)]).tolist()
    return [values[a:b] for a, b in zip(cuts, cuts[1:])]


def edit_distance(a: list[int], b: list[int]) -> int:
    """Words to insert, delete or replace: a bit for each word of ``a`` in a Python integer, one step for each of ``b``."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    n = len(a)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    for y in b:
        eq = places.get(y, 0)
        vertical = eq | minus
        eq |= (((eq & plus) + plus) ^ plus) & full
        up, down = minus | ~(eq | plus) & full, plus & eq
        score += (up & top > 0) - (down & top > 0)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
    return score


def similar(a: list[int], b: list[int], threshold: float) -> bool:
    """Whether the edit distance is at most 1 - ``threshold`` of the longer; cheaper bounds decide first where they can."""
    longest, shortest = max(len(a), len(b)), min(len(a), len(b))
    allowed = int((1 - threshold) * longest + 1e-9)
    if longest - shortest > allowed:
        return False
    start = 0
    while start < shortest and a[start] == b[start]:
        start += 1
    end = 0
    while end < shortest - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]  # equal ends cost nothing
    left = max(len(a), len(b))
    if left <= allowed:
        return True
    kinds, others = set(a), set(b)
    both = len(kinds & others) + min(len(a) - len(kinds), len(b) - len(others))  # at least as many words as they share
    return left - both <= allowed and edit_distance(a, b) <= allowed


def numbered(words: list[int]) -> list[int]:
    """A hash of each word with how often it came before: two similar paragraphs of n words share threshold * n of these."""
    seen: dict[int, int] = {}
    out = []
    for w in words:
        k = seen[w] = seen.get(w, 0) + 1
        out.append((w * 0x9E3779B97F4A7C15 + k * 0xD6E8FEB86659FD93 & (1 << 63) - 1) ^ k)
    return out


def numbered_rows(x: np.ndarray) -> np.ndarray:
    """``numbered`` of each row."""
    k = np.ones(x.shape, U)
    for j in range(1, x.shape[1]):
        k[:, j] += np.count_nonzero(x[:, :j] == x[:, j : j + 1], axis=1).astype(U)
    return (x * U(0x9E3779B97F4A7C15) + k * U(0xD6E8FEB86659FD93) & U((1 << 63) - 1)) ^ k


def prefix_size(n: int, threshold: float) -> int:
    """Two sets that share threshold * n of their n elements share one of so many first ones in any common order."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def cluster(units: list[int], prefixes: list[list], alike, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Links whose components are those of all pairs that are alike, given that those share an element of their prefixes.

    ``alike(i, j)`` compares two members; one is compared with the members of a cluster until one is alike. Members with
    the same of ``roots`` are linked already.
    """
    parent = list(range(len(units)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    if roots is not None:
        held: dict[int, int] = {}
        for i, r in enumerate(roots):
            parent[i] = held.setdefault(r, i)
    places: dict[object, dict[int, list[int]]] = {}  # element -> cluster (as it was) -> members
    out = []
    for i, prefix in enumerate(prefixes):
        unlike: set[int] = set()
        for e in prefix:
            for c, members in places.setdefault(e, {}).items():
                if root(c) == root(i):
                    continue
                for j in reversed(members):
                    if j in unlike:
                        continue
                    if alike(i, j):
                        out.append((units[i], units[j]))
                        parent[root(i)] = root(c)
                        break
                    unlike.add(j)
        own = root(i)
        for e in prefix:
            places[e].setdefault(own, []).append(i)
    return out


def similar_rows(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, threshold: float) -> np.ndarray:
    """``similar`` for each row of words of x and y (nx and ny of them), by ``edit_distance`` for all rows at once."""
    if x.shape[1] > 63:
        return np.array([similar(a[:n].tolist(), b[:m].tolist(), threshold) for a, n, b, m in zip(x, nx, y, ny, strict=True)], bool)
    out = np.zeros(len(x), bool)
    bits = np.zeros((len(x), 8), np.uint8)
    one = U(1)
    full, top = (one << nx.astype(U)) - one, (nx - 1).astype(U)
    plus, minus, score = full.copy(), np.zeros(len(x), U), nx.astype(np.int64)
    for j in range(int(ny.max(initial=0))):
        found = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little")
        bits[:, : found.shape[1]] = found
        eq = bits.view("<u8").ravel() & full
        vertical = eq | minus
        eq |= (((eq & plus) + plus) ^ plus) & full
        up, down = minus | ~(eq | plus) & full, plus & eq
        on = j < ny
        score += np.where(on, (up >> top & one).astype(np.int64) - (down >> top & one).astype(np.int64), 0)
        up, down = (up << one | one) & full, down << one & full
        plus, minus = np.where(on, down | ~(vertical | up) & full, plus), np.where(on, up & vertical, minus)
    out[:] = score <= ((1 - threshold) * np.maximum(nx, ny) + 1e-9).astype(np.int64)
    return out


def may_be_similar(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, most: int) -> np.ndarray:
    """False only for rows that more than ``most`` edits tell apart (``x``, ``y``: a byte of each word, filled up with zeros).

    Of as many words, one that stays moves by half the edits at most; all but ``most`` have an equal one that near.
    """
    width, reach = x.shape[1], most // 2
    met = x == y
    for d in range(1, reach + 1):
        met[:, d:] |= x[:, d:] == y[:, : width - d]
        met[:, : width - d] |= x[:, : width - d] == y[:, d:]
    return (nx != ny) | (width - np.count_nonzero(met, axis=1) <= most)


@dataclass(frozen=True)
class Words:
    """The words of paragraphs, looked up by their hashes."""

    store: Store
    shape: Shape

    def packed(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, words = self.store.lookup(units.view(U), [1, 2])
        return size.astype(np.int64), words

    def rows(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, a row for each paragraph, filled up with zeros; how many each has)."""
        size, words = self.packed(units)
        wide = np.zeros((len(units), self.shape.words, 8), np.uint8)
        if len(units):
            wide[:, :, :WORD_BYTES] = words.view(np.uint8).reshape(len(units), self.shape.words, WORD_BYTES)
        return wide.view("<u8")[:, :, 0], size


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for many integers faster than numpy's ``unique``."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


#: Pairs that a task looks at, and compares, at once.
AT_ONCE, COMPARED = 300_000, 10_000


def unite(group: np.ndarray, unit: np.ndarray, words: Words, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links whose components are those of all similar pairs within the groups (rows in order of ``group``).

    A bit for each of a paragraph's words rules most pairs out: one has no more bits that the other lacks than edits.
    Of groups of more than ``FEW`` each member is compared with the first, then those that share one of their rarest
    words, as many as leave out no similar pair. Members with the same of ``root`` are linked already.
    """
    kinds, at = np.unique(unit, return_inverse=True)
    x, size = words.rows(kinds)
    low = x.astype(np.uint8)
    allowed = np.array([edits(n, words.shape.threshold) for n in range(words.shape.words + 1)])
    most = edits(words.shape.words, words.shape.threshold)
    inside = np.arange(x.shape[1]) < size[:, None]
    mask = [np.bitwise_or.reduce(np.where(inside, U(1) << (x >> U(s) & U(63)), U(0)), axis=1) for s in (0, 6)]
    label = np.arange(len(kinds))
    if root is not None:  # links without a comparison
        order = np.argsort(root, kind="stable")
        same = np.flatnonzero(root[order][1:] == root[order][:-1])
        node, least = forest(at[order[same + 1]], at[order[same]])
        label[node] = least
    known = np.flatnonzero(label != np.arange(len(kinds))), label[label != np.arange(len(kinds))]
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]  # links
    wait: list[np.ndarray] = []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        for c in range(0, len(i), COMPARED):
            p, q = i[c : c + COMPARED], j[c : c + COMPARED]
            good = (size[p] == size[q]) & (np.count_nonzero(x[p] != x[q], axis=1) <= allowed[size[p]])  # words changed, none moved
            rest = np.flatnonzero(~good)
            good[rest] = similar_rows(x[p[rest]], size[p[rest]], x[q[rest]], size[q[rest]], words.shape.threshold)
            a.append(p[good])
            b.append(q[good])
        a[:], b[:] = zip(forest(np.concatenate(a), np.concatenate(b)))
        node, least = forest(np.concatenate([*a, known[0]]), np.concatenate([*b, known[1]]))
        label = np.arange(len(kinds))
        label[node] = least

    def verify() -> None:
        pairs = distinct(np.concatenate(wait))
        wait.clear()
        i, j = pairs // len(kinds), pairs % len(kinds)
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        near = [may_be_similar(low[p], low[q], size[p], size[q], most) for c in range(0, len(i), COMPARED) for p, q in [(i[c : c + COMPARED], j[c : c + COMPARED])]]
        near = np.concatenate([np.zeros(0, bool), *near])
        i, j = i[near], j[near]
        for whole in (False, True):  # one pair of each paragraph, then those that are still apart
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            some = np.arange(len(i)) if whole else np.unique(i, return_index=True)[1]
            compare(i[some], j[some])

    def all_pairs(group: np.ndarray, at: np.ndarray) -> None:
        before = np.arange(len(group)) - np.searchsorted(group, group)  # members that come before
        total = np.cumsum(before)
        lo = 0
        while lo < len(group):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + AT_ONCE)))
            n = before[lo:hi]
            left = np.repeat(np.arange(lo, hi), n)
            i, j = at[left], at[left - 1 - (np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n))]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            for m in mask:
                y, z = m[i], m[j]
                keep = (np.bitwise_count(y & ~z) <= most) & (np.bitwise_count(z & ~y) <= most)
                i, j = i[keep], j[keep]
            wait.append(distinct(np.maximum(i, j) * len(kinds) + np.minimum(i, j)))
            if sum(map(len, wait)) > AT_ONCE:
                verify()
            lo = hi
        if wait:
            verify()

    def starred(group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compare each member with the first; what is left in more than one component."""
        first = np.flatnonzero(np.diff(group, prepend=-1))
        size_of = np.diff(first, append=len(group))
        one = np.repeat(at[first], size_of) if len(first) else at
        apart = label[one] != label[at]
        pairs = distinct(np.maximum(one, at)[apart] * len(kinds) + np.minimum(one, at)[apart])
        compare(pairs // len(kinds), pairs % len(kinds))
        if not len(first):
            return group, at
        still = np.repeat(np.minimum.reduceat(label[at], first) != np.maximum.reduceat(label[at], first), size_of)
        return group[still], at[still]

    def by_rarest(group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups of those that share one of the rarest words of their groups."""
        keys = join_hash(np.repeat(group.astype(U), x.shape[1]), numbered_rows(x[at]).ravel())
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        which = which.reshape(len(at), x.shape[1])
        often = np.where(np.arange(x.shape[1]) < size[at][:, None], times[which], len(keys) + 1)  # the same order in all of a group
        order = np.argsort(often * (len(times) + 1) + which, axis=1)
        prefix = np.array([prefix_size(n, words.shape.threshold) if n else 0 for n in range(x.shape[1] + 1)])
        row, col = np.nonzero(np.arange(x.shape[1]) < prefix[size[at]][:, None])
        element = which[row, order[row, col]]
        row, element = row[times[element] > 1], element[times[element] > 1]
        order = np.argsort(element, kind="stable")
        return element[order], at[row[order]]

    ids = np.cumsum(np.diff(group, prepend=group[:1]) != 0)
    large = (np.bincount(ids, minlength=1)[ids] if len(ids) else ids) > FEW
    all_pairs(ids[~large], at[~large])
    if large.any():
        all_pairs(*starred(*by_rarest(*starred(ids[large], at[large]))))
    node, least = forest(np.concatenate(a), np.concatenate(b))
    return kinds[node], kinds[least]


def _read(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[tuple[np.ndarray, Paragraphs]]:
    """(doc ids, paragraphs) of blocks of the columns doc_id and text."""
    for part in slices(batches):
        ids = np.array([NULL_ID if x is None else x for x in part.column(0).to_pylist()], np.int64)
        texts = utf8(part.column(1))
        for a, b in blocks(texts):
            yield ids[a:b], Paragraphs(texts[a:b], shape)


def shared_keys(docs: DataFrame, shape: Shape, bits: int) -> Store:
    """Shingles of paragraphs that two or more rows have, and how frequent each is (a power of two; step 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # keys, in the low 16 bits the row
        n = rows = 0

        def flush() -> pa.RecordBatch:
            keys = distinct(np.concatenate(held)) & ~U(0xFFFF)  # a row counts once
            held.clear()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            times = np.minimum(np.diff(first, append=len(keys)), 255)
            keys = keys[first]
            return block_batch(list(to_blocks(keys, [(keys >> U(32)).astype("u4"), (keys >> U(16)).astype("u2"), times.astype("u1")], bits)))

        for ids, p in _read(batches, shape):
            for q, at in p.places():
                row = np.searchsorted(p.first, at, side="right") - 1 + rows
                held.append(p.shingles(q)[at] | row.astype(U))
                n += len(at)
            rows += len(ids)
            if n and (n > 1_000_000 or rows > 60_000):  # a block has 500 rows at most
                yield flush()
                n = rows = 0
            rows *= n > 0
        if n:
            yield flush()

    def merge(arrays: list[np.ndarray]):
        high, low, times = arrays
        keys = high.astype(U) << U(32) | low.astype(U) << U(16)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, times = keys[first], np.add.reduceat(times.astype(np.int64), first)
        shared = times > 1
        return [keys[shared], np.ceil(np.log2(times[shared]))], []

    return build(docs.mapInArrow(run, BLOCK), "keys", bits, ["u4", "u2", "u1"], ["u8", "u1"], merge)[0]


def _range(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, with the smallest ``low`` and largest ``high`` of each."""
    order = np.argsort(keys)
    keys, low, high = keys[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def _candidates(docs: DataFrame, shape: Shape, keys, bits: int) -> DataFrame:
    """Packed blocks (step 2): kind 0 (paragraph, smallest, largest document), kind 1 (key, paragraph)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = keys.value
        units: list[tuple[np.ndarray, ...]] = []
        pairs: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            u, low, high = _range(*map(np.concatenate, zip(*units, strict=True)))
            k, unit = map(np.concatenate, zip(*pairs, strict=True))
            k, unit = _rows_once(k & ~U(0xFFFFFF) | (k & U(0xFF)) << U(16) | unit >> U(48), k, unit)
            rows = [(0, *x) for x in to_blocks(u, [u, low, high], bits)] + [(1, *x) for x in to_blocks(k, [k, unit], bits)]
            units.clear()
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "bucket", "payload"])

        for ids, p in _read(batches, shape):
            if not len(p.at):
                continue
            kind = {}
            for q, at in p.places():
                kind[q] = np.zeros(len(p.h), np.uint8)
                (kind[q][at],) = store.lookup(p.shingles(q)[at], [1])
            row, k = p.sketch(kind)
            which = np.unique(row)
            if len(which):
                units.append((p.unit[which], ids[p.text[which]], ids[p.text[which]]))
                pairs.append((k, p.unit[row]))
                n += len(row)
            if n > 1_000_000:
                yield flush()
                n = 0
        if n:
            yield flush()

    return docs.mapInArrow(run, f"kind int, {BLOCK}")


def _rows_once(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b in the given order without neighbours that are equal (nearly all that are, if equal ones are as large in ``order``)."""
    by = np.argsort(order)
    a, b = a[by], b[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def candidate_groups(k: np.ndarray, unit: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """group, unit, n of (key and place, paragraph) pairs: for each key sets of n different paragraphs, such that all pairs
    that have the key within ``reach`` are in a set. A set has the same name, whichever key makes it.
    """
    order = np.argsort(k)
    k, unit = k[order], unit[order]
    key, place = k >> U(16), (k & U(0xFFFF)).astype(np.int64)
    new = np.ones(len(k), bool)
    new[1:] = key[1:] != key[:-1]
    last = np.append(np.flatnonzero(new[1:]), len(k) - 1) if len(k) else np.zeros(0, int)
    loose = (place[last] == ANYWHERE)[np.cumsum(new) - 1]  # a paragraph has the key in many places
    far = np.ones(len(k), bool)
    far[1:] = place[1:] - place[:-1] > reach
    first = new | far & ~loose
    chain = np.cumsum(first)
    place -= place[first][chain - 1]
    width = reach + 2
    window = np.where(loose | (np.bincount(chain)[chain] <= FEW), 0, place // width)  # two within reach are in the window of the first
    again = np.flatnonzero((window > 0) & (place % width < reach))
    chain = np.unique(np.concatenate([chain << 17 | window, chain[again] << 17 | window[again] - 1]), return_inverse=True)[1] if window.any() else chain
    unit = np.concatenate([unit, unit[again]])
    left = 64 - int(chain.max(initial=0)).bit_length()  # bits of the paragraph that fit beside
    chain, unit = _rows_once(chain.astype(U) << U(left) | unit >> U(64 - left), chain, unit)
    first = np.flatnonzero(np.diff(chain, prepend=-1))
    size = np.diff(first, append=len(chain))
    names = mix(np.add.reduceat(mix(unit), first)) if len(first) else np.zeros(0, U)
    kinds = np.flatnonzero(size > 1)
    kinds = kinds[np.unique(names[kinds], return_index=True)[1]]
    chosen = np.zeros(len(first), bool)
    chosen[kinds] = True
    keep = np.repeat(chosen, size)
    return np.repeat(names, size)[keep].view(np.int64), unit[keep].view(np.int64), np.repeat(size, size)[keep]


def _gather(candidates: DataFrame, shape: Shape, bits: int) -> tuple[Store, DataFrame]:
    """The store of candidate paragraphs (hash, smallest, largest document), and group, unit, n: the sets of different
    paragraphs that share a key, each set once however many bands find it. Both kinds of blocks meet in one exchange.
    """
    folder = scratch(candidates.sparkSession, "units")

    def run(key, table):
        bucket = key[1].as_py()
        if key[0].as_py() == 0:
            arrays = _range(*(np.concatenate(c) for c in zip(*(unpack(p.as_py(), ["u8", "i8", "i8"]) for p in table.column("payload")), strict=True)))
            write_array(folder, str(bucket), list(arrays))
            return pa.table({"group": pa.array([None], pa.int64()), "unit": pa.array([len(arrays[0])], pa.int64()), "n": pa.array([0], pa.int64()), "bucket": pa.array([bucket], pa.int32())})
        k, unit = (np.concatenate(c) for c in zip(*(unpack(p.as_py(), ["u8", "u8"]) for p in table.column("payload")), strict=True))
        del table
        group, unit, n = candidate_groups(k, unit, shape.reach)
        return pa.table({"group": pa.array(group), "unit": pa.array(unit), "n": pa.array(n), "bucket": pa.nulls(len(n), pa.int32())})

    done = materialise(candidates.groupBy("kind", "bucket").applyInArrow(run, "group long, unit long, n long, bucket int"), "gathered")
    sizes = {r.bucket: r.unit for r in done.where("bucket is not null").collect() if r.unit}  # one row a bucket
    store = Store(folder, bits, ["u8", "i8", "i8"], sizes).fetch(candidates.sparkSession)
    free_shuffles(candidates.sparkSession)
    groups = materialise(done.where("bucket is null").select("group", "unit", "n").distinct(), "groups")
    drop_scratch(candidates.sparkSession, done)
    free_shuffles(candidates.sparkSession)
    return store, groups


def _words(docs: DataFrame, groups: DataFrame, units, shape: Shape, bits: int) -> Words:
    """The words of the paragraphs of ``groups``, each from its first document."""

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = np.unique(batch.column(0).to_numpy().view(U))
            yield block_batch(list(to_blocks(u, [u], bits)))

    wanted, _ = build(groups.select("unit").mapInArrow(blocks_of, BLOCK), "wanted", bits, ["u8"], ["u8"], lambda a: ([np.unique(a[0])], []))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, p in _read(batches, shape):
            which = np.flatnonzero(shared.value.contains(p.unit))
            (low,) = units.value.lookup(p.unit[which], [1])
            which = which[low == ids[p.text[which]]]  # of equal paragraphs the first document's
            u, nth = np.unique(p.unit[which], return_index=True)
            if len(u):
                yield block_batch(list(to_blocks(u, [u, p.size[which[nth]].astype("u2"), p.packed(which[nth])], bits)))

    def merge(arrays: list[np.ndarray]):
        u, nth = np.unique(arrays[0], return_index=True)
        return [u, *(a[nth] for a in arrays[1:])], []

    kinds = ["u8", "u2", f"V{WORD_BYTES * shape.words}"]
    return Words(build(docs.mapInArrow(run, BLOCK), "words", bits, kinds, kinds, merge)[0], shape)


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _star_links(groups: DataFrame, words, threshold: float) -> DataFrame:
    """Edges a, b between each group's smallest paragraph and its others, where similar."""
    smallest = groups.groupBy("group").agg(F.min("unit").alias("a"), F.count("*").alias("n"))
    pairs = join_counted(groups.select("group", "unit"), smallest, ["group"], "n", groups.count()).where("unit <> a").select("a", F.col("unit").alias("b")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, COMPARED):
            a, b = (c.to_numpy() for c in part.columns)
            keep = similar_rows(*words.value.rows(a), *words.value.rows(b), threshold)
            yield _edges(a[keep], b[keep])

    return pairs.mapInArrow(run, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch], names: int, rows: int = 40_000) -> Iterator[list[np.ndarray]]:
    """The columns (longs) of sorted batches, about ``rows`` at a time; rows that agree in the first ``names`` columns stay together."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in and_end(batches):
        if batch is not None:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
        if not n or (batch is not None and n < rows):
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = n
        if batch is not None:
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:names]], axis=0)) + 1
            cut = int(ends[-1]) if len(ends) else 0
        if cut:
            yield [c[:cut] for c in columns]
        held, n = [[c[cut:] for c in columns]], n - cut
    give_back()


def _small_links(groups: DataFrame, words, bits: int) -> DataFrame:
    """Blocks of edges that unite what is similar in groups that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from edge_blocks((unite(group, unit, words.value) for group, unit in _whole_groups(batches, 1)), bits)

    met = groups.select("group", "unit").repartition(parallelism(groups.sparkSession), "group")
    return met.sortWithinPartitions("group", "unit").mapInArrow(run, BLOCK)


def _group_links(groups: DataFrame, roots: DataFrame, words, threshold: float, dealt: int) -> DataFrame:
    """Blocks (``dealt``: their bits) of edges that unite what is similar in large groups that ``roots`` doesn't yet make one component of."""

    def elements(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key of group and element) of each element of the paragraphs, and how many each paragraph has."""
        x, sizes = words.value.rows(part.column(1).to_numpy())
        row, col = np.nonzero(np.arange(x.shape[1]) < sizes[:, None])
        return row, join_hash(part.column(0).to_numpy().view(U)[row], numbered_rows(x)[row, col]), sizes

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in and_end(slices(batches)):
            if part is not None:
                held.append(elements(part)[1])
            if held and (part is None or sum(map(len, held)) > 600_000):
                keys = np.concatenate(held)
                held = []
                keys, times = sum_by_key(keys, np.ones(len(keys), np.int64))
                yield block_batch(list(to_blocks(keys, [keys, times], bits)))

    def merge(arrays: list[np.ndarray]):
        keys, times = sum_by_key(*arrays)
        return [keys[times > 1], times[times > 1]], []

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, key, sizes = elements(part)
            (times,) = counts.value.lookup(key, [1])
            order = np.lexsort((key, times, row))  # the same order in all paragraphs of a group
            row, key, times = row[order], key[order], times[order]
            nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = np.array([prefix_size(int(n), threshold) for n in sizes])
            keep = (nth < first[row]) & (times > 1)
            whole = part.take(pa.array(row[keep]))
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array(key[keep].view(np.int64)), *whole.columns[1:]], ["group", "element", "unit", "root"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _whole_groups(batches, 2)
        yield from edge_blocks((unite(join_hash(group.view(U), element.view(U)).view(np.int64), unit, words.value, root) for group, element, unit, root in sets), dealt)

    named = groups.join(roots.select(F.col("node").alias("unit"), "root"), "unit", "left").select("group", "unit", F.coalesce("root", "unit").alias("root"))
    open_ = named.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("group", "n", F.lit(True).alias("open"))
    members = materialise(join_counted(named, open_, ["group"], "n", groups.count()).select("group", "unit", "root"), "open")
    bits = buckets_for(members.count() * 30 * 16, BUCKET_BYTES)
    # an element that one paragraph of the group has (missing in the store) links nothing; of the others the rarest come first
    store, _ = build(members.mapInArrow(counted, BLOCK), "elements", bits, ["u8", "i8"], ["u8", "i8"], merge)
    counts = groups.sparkSession.sparkContext.broadcast(store)
    met = members.mapInArrow(rarest, "group long, element long, unit long, root long")
    return met.repartition(parallelism(groups.sparkSession), "group", "element").sortWithinPartitions("group", "element", "unit").mapInArrow(verify, BLOCK)


def _verdicts(units, roots, bits: int, spark) -> Store:
    """(paragraph, first, last document) of all candidates: for those in components the first and last of the component."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[int]:
        for batch in batches:
            yield from batch.column(0).to_pylist()

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in numbers(batches):
            node, root = (np.asarray(x) for x in roots.value.bucket(bucket))
            if len(node):
                root, low, high = _range(root, *units.value.lookup(node, [1, 2]))
                own_low, own_high = units.value.lookup(root, [1, 2])  # a member too
                facts = _range(mix(root), np.minimum(low, own_low), np.maximum(high, own_high))  # roots are small hashes: few buckets
                yield block_batch(list(to_blocks(facts[0], list(facts), bits)))

    def merge(arrays: list[np.ndarray]):
        return list(_range(*arrays)), []

    buckets = spark.range(0, 1 << bits, 1, parallelism(spark))
    kinds = ["u8", "i8", "i8"]
    classes = spark.sparkContext.broadcast(build(buckets.mapInArrow(members, BLOCK), "classes", bits, kinds, kinds, merge)[0])
    folder = scratch(spark, "verdicts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in numbers(batches):
            unit, low, high = (np.asarray(x) for x in units.value.bucket(bucket))
            if len(unit):
                linked, (root,) = roots.value.find(unit, [1])
                near, (first, last) = classes.value.find(mix(np.where(linked, root, unit)), [1, 2])
                write_array(folder, str(bucket), [unit, np.where(near, first, low), np.where(near, last, high)])
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(unit)], pa.int64())], ["bucket", "n"])

    sizes = {r.bucket: r.n for r in buckets.mapInArrow(write, "bucket int, n long").collect()}  # one row a bucket
    return Store(folder, bits, kinds, sizes).fetch(spark)


def repeated_passages(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_paragraphs, n_repeated (its paragraphs that a smaller doc_id
    keeps), n_shared (those that it keeps and others repeat), n_removed_words, spans (start, end of the words to remove),
    keep_ids (the documents that keep them).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    bits = buckets_for(n_bytes * 2, BUCKET_BYTES)
    send = spark.sparkContext.broadcast
    keys = shared_keys(docs, shape, bits)
    free_shuffles(spark)
    exact, groups = _gather(_candidates(docs, shape, send(keys), bits), shape, bits)
    drop_scratch(spark, keys.folder)
    units = send(exact)
    words = send(_words(docs, groups, units, shape, bits))
    links = _small_links(groups.where(F.col("n") <= GROUP), words, bits)
    large = groups.where(F.col("n") > GROUP)
    if not large.isEmpty():
        stars = materialise(_star_links(large, words, shape.threshold), "stars")
        found = materialise(components(stars), "roots")
        starred = stars.mapInArrow(lambda batches: edge_blocks(((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), bits), BLOCK)
        links = links.unionByName(starred).unionByName(_group_links(large, found, words, shape.threshold, bits))
    final = send(_verdicts(units, send(component_store(links, bits)), bits, spark))

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for ids, p in _read(batches, shape):
            known, (low, high) = final.value.find(p.unit, [1, 2])
            own = ids[p.text]
            repeated, shared = known & (low != own), known & (low == own) & (high != own)
            n = len(ids)
            count = lambda mask: np.bincount(p.text[mask], minlength=n)
            i = np.flatnonzero(repeated)
            i = i[np.argsort(p.text[i], kind="stable")]
            text, start = p.text[i], p.at[i] - p.first[p.text[i]]
            end = start + p.size[i]  # in order within a text: its paragraphs are as long
            new = np.ones(len(i), bool)
            new[1:] = (text[1:] != text[:-1]) | (start[1:] > end[:-1])
            first = np.flatnonzero(new)
            text_of, start, end = text[first], start[first], end[np.append(first[1:] - 1, len(i) - 1)] if len(i) else end
            removed = np.bincount(text_of, end - start, minlength=n).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=n))])
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], fields=list(span)))
            order = np.lexsort((low[i], text))
            keeper, text = low[i][order], text[order]
            new = np.ones(len(i), bool)
            new[1:] = (text[1:] != text[:-1]) | (keeper[1:] != keeper[:-1])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=n))])
            keep = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keeper[new], pa.int64()))
            none = ids == NULL_ID
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=none), pa.array(np.diff(p.first)), pa.array(np.bincount(p.text, minlength=n)), pa.array(count(repeated)), pa.array(count(shared)), pa.array(removed), spans, keep],
                ["doc_id", "n_words", "n_paragraphs", "n_repeated", "n_shared", "n_removed_words", "spans", "keep_ids"],
            )

    return docs.mapInArrow(verdict, "doc_id long, n_words long, n_paragraphs long, n_repeated long, n_shared long, n_removed_words long, spans array<struct<start:int,end:int>>, keep_ids array<long>")


def cut(text: str, spans: list) -> str:
    """``text`` without the words of the spans, white space between the others kept."""
    import re

    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    gone = [(words[s["start"]][0], words[s["end"]][0] if s["end"] < len(words) else len(text)) for s in spans]
    out, at = [], 0
    for a, b in gone:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])
