"""Language identification by words first, then shorter and shorter character n-grams.

A known word scores by its log frequency in each language. An unseen word backs off: its longest
known character n-grams (of ``orders``, word ends marked by spaces) score it, averaged; shorter ones
are tried only if no longer one is known. Word scores add up to a posterior over languages.

The model is fitted on a bounded sample: of each language about ``docs_per_lang`` labelled
documents, those with the smallest hashes of their id. All words of the sample and all their n-grams
are in its tables; nothing is cut.

Defined results: a letter is a character of a Unicode category L; null texts and texts without a
letter give ``und`` with score 0; so does everything when there is nothing to learn from; rows with a
null lang are not learnt from; equal posteriors go to the language that sorts first; repeated rows
each get a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .words import mix

#: A run of letters and of what regular expressions take for such (other numbers, as in superscripts and fractions).
_RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_in(text: str) -> list[str]:
    """The runs of letters (Unicode category L) of the lower-cased text."""
    runs = _RUN.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [w for r in runs for w in ("".join(c if c.isalpha() else " " for c in r).split() if not r.isalpha() else (r,))]


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of all runs of n code points."""
    out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out + codes[k : len(codes) - n + 1 + k].astype(np.uint64) + np.uint64(1))
    return out


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]  # word -> row of table
    keys: dict[int, np.ndarray]  # for each order the sorted keys of its n-grams, and their rows
    rows: dict[int, np.ndarray]
    table: np.ndarray  # log frequency of each entry in each language
    orders: tuple[int, ...]
    weight: float

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words that are not in ``words``, by their longest known n-grams."""
        text = "".join(f" {w} " for w in words)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(w) + 2 for w in words])
        word_at = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        out = np.zeros((len(words), len(self.langs)), np.float32)
        todo = np.ones(len(words), bool)
        for n in self.orders:
            keys = self.keys.get(n, np.zeros(0, np.uint64))
            at = np.flatnonzero(todo[word_at[: len(codes) - n + 1]] & (word_at[: len(codes) - n + 1] == word_at[n - 1 :])) if len(codes) >= n else []
            if not len(keys) or not len(at):
                continue
            wanted = gram_keys(codes, n)[at]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[found] == wanted
            whose, rows = word_at[at[hit]], self.rows[n][found[hit]]
            times = np.bincount(whose, minlength=len(words))
            for lang in range(len(self.langs)):
                out[:, lang] += np.bincount(whose, self.table[rows, lang], len(words)) / np.maximum(times, 1) * self.weight
            todo &= times == 0
        return out


class Scorer:
    """Adds up word scores; ``limit`` bounds the worker's cache of unseen words."""

    def __init__(self, model: Model, limit: int = 600_000):
        self.model, self.limit = model, limit
        self.base = len(model.table)
        self.seen = np.zeros((self.base + limit, len(model.langs)), np.float32)
        self.seen[: self.base] = model.table
        self.at = dict(model.words)

    def rows(self, words: list[str]) -> list[int]:
        rows = list(map(self.at.get, words))
        if None in rows:
            new = sorted({w for w, r in zip(words, rows, strict=True) if r is None})
            if len(self.at) + len(new) > len(self.model.words) + self.limit:
                self.at = dict(self.model.words)
                new = sorted({w for w in words if w not in self.at})
            first = self.base + len(self.at) - len(self.model.words)
            self.seen[first : first + len(new)] = self.model.unseen(new)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
            rows = list(map(self.at.__getitem__, words))
        return rows

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_in(t or "") for t in texts]
        total = np.zeros((len(texts), len(self.model.langs)))
        flat = [w for s in split for w in s]
        whose = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        for a in range(0, len(flat), 100_000):
            scores = self.seen[self.rows(flat[a : a + 100_000])]
            first = np.flatnonzero(np.diff(whose[a : a + 100_000], prepend=-1))
            total[whose[a + first]] += np.add.reduceat(scores, first, axis=0, dtype=np.float64)
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        likely = np.exp(total - total.max(axis=1, keepdims=True))
        best = likely.argmax(axis=1)
        score = likely.max(axis=1) / likely.sum(axis=1)
        return [(self.model.langs[b], float(x)) if s else (UNKNOWN, 0.0) for b, x, s in zip(best, score, split, strict=True)]


def sample(labelled: DataFrame, docs_per_lang: int) -> DataFrame:
    """About ``docs_per_lang`` rows of each lang: those whose id hashes lowest."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # the model has a column for each
    if not counts:
        return labelled.select("lang", "text").limit(0)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, docs_per_lang / n))))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return labelled.where(place < share[F.col("lang")]).select("lang", "text")


def fit(labelled: DataFrame, docs_per_lang: int = 500, orders: tuple[int, ...] = (5, 4, 3, 2, 1), weight: float = 0.5) -> Model:
    """Learn from the columns doc_id, text, lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], Counter] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = Counter(words_in(text or ""))
                seen.setdefault((lang, 0), Counter()).update(words)
                for n in orders:
                    into = seen.setdefault((lang, n), Counter())
                    for w, k in words.items():
                        for g in grams(w, n):
                            into[g] += k
            rows = [(lang, n, g, k) for (lang, n), c in seen.items() for g, k in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ([], [], [], []), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "n", "gram", "k"])

    counted = materialise(sample(labelled.where("lang is not null"), docs_per_lang).mapInArrow(count, "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k")), "grams")
    sums = {(r.lang, r.n): (r.total, r.kinds) for r in counted.groupBy("lang", "n").agg(F.sum("k").alias("total"), F.count("*").alias("kinds")).collect()}
    top = counted.select("lang", "n", "gram", "k").collect()  # the sample bounds it
    langs = sorted({lang for lang, _ in sums})
    at_lang = {lang: i for i, lang in enumerate(langs)}
    rows: dict[tuple[int, str], int] = {}
    hits = [(rows.setdefault((r.n, r.gram), len(rows)), at_lang[r.lang], r.k) for r in sorted(top)]
    table = np.zeros((len(rows), len(langs)))
    for at, lang, k in hits:
        table[at, lang] = k
    total = np.array([[sums.get((lang, n), (0, 0))[0] + 0.5 * (sums.get((lang, n), (0, 0))[1] + 1) for lang in langs] for n in range(max(orders, default=0) + 1)])
    if rows:
        table = np.log((table + 0.5) / total[[n for n, _ in rows]])
    keys, places = {}, {}
    for n in orders:
        mine = [(g, at) for (m, g), at in rows.items() if m == n]
        k = np.array([gram_keys(np.frombuffer(g.encode("utf-32-le"), np.uint32), n)[0] for g, _ in mine], np.uint64)
        places[n] = np.array([at for _, at in mine], int)[np.argsort(k)]
        keys[n] = np.sort(k)
    return Model(langs, {g: at for (n, g), at in rows.items() if not n}, keys, places, table.astype(np.float32), tuple(orders), weight)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs``; only its text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = scorer.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
