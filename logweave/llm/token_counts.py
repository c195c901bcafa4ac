"""Token counts by a map-side two-tier lookup, without shuffling any pre-token.

Tier 1 is a broadcast table of the lengths (in tokens) of frequent pre-tokens: at most
1 / ``share`` entries, so its size is bounded whatever the corpus. Frequencies come from one pass
over all documents that keeps bounded counters in each task and sums the survivors; they decide
only what is answered fast, never a count. Tier 2 is a bounded cache in each worker: the misses of
a batch are encoded together by the tokenizer library and remembered.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The byte-level BPE pre-token pattern, and its special token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"

#: Characters on which the regex module and the tokenizer's own engine agree about letter, number and space; a
#: text with any other is encoded whole by the library.
_ODD = re.compile("[^\x00-ԯ‐-⁞ぁ-ゖァ-ヺ一-龥가-힣]")


class Lengths(dict):
    """Pre-token -> number of tokens; ``fill`` encodes what is missing, ``limit`` bounds the cache."""

    def __init__(self, table: dict[str, int], tokenizer, limit: int):
        super().__init__(table)
        self.table, self.tokenizer, self.limit = table, tokenizer, limit

    def fill(self, wanted: set[str]) -> None:
        if missing := [x for x in wanted if x not in self]:
            if len(self) + len(missing) > self.limit + len(self.table):
                self.clear()
                self.update(self.table)
                missing = [x for x in wanted if x not in self]
            for a in range(0, len(missing), 20_000):
                part = missing[a : a + 20_000]
                self.update(zip(part, (len(e) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def count(self, texts: list[str], findall: Callable[[str], list[str]]) -> list[int]:
        out = []
        for a in range(0, len(texts), 64):
            split = [None if _ODD.search(t) else findall(t) if SPECIAL not in t else [p for part in t.split(SPECIAL) for p in findall(part)] for t in texts[a : a + 64]]
            self.fill(set().union(*(s for s in split if s)))
            for t, s in zip(texts[a : a + 64], split, strict=True):
                if s is None:
                    out.append(len(self.tokenizer.encode(t, add_special_tokens=False)))
                else:
                    out.append(sum(map(self.__getitem__, s)) + t.count(SPECIAL))
        return out


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def frequent_words(docs: DataFrame, share: float, counters: int = 100_000) -> list[str]:
    """Space-separated words that make up at least ``share`` of all words: at most 1 / share of them.

    A task holds at most ``counters`` counters (the rarer half go when they run out) and hands on those of its words
    that reach the share within it, so that what meets is bounded for each task and in all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = (text or "").split(" ")
                total += len(words)
                seen.update(words)
                if len(seen) > counters:
                    seen = Counter(dict(seen.most_common(counters // 2)))
        top = [(w, n) for w, n in seen.items() if n >= share * total]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top] + [None], pa.string()), pa.array([n for _, n in top] + [total], pa.int64())], ["word", "n"])

    counted = materialise(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counted.where("word is null").select("n").first()
    return [r.word for r in counted.where(F.col("word").isNotNull() & (F.col("n") >= share * (total.n if total else 0))).collect()]


def token_counts(docs: DataFrame, tokenizer_path: str, share: float = 5e-5, cache: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs``."""
    spark = docs.sparkSession
    tokenizer = load(tokenizer_path)
    words = [" " + w for w in frequent_words(docs, share) if w.isalpha() and not _ODD.search(w)]
    table = dict(zip(words, (len(e) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)), strict=True)) if words else {}
    shared = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        findall, lengths = regex.compile(PATTERN).findall, Lengths(shared.value, load(tokenizer_path), cache)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(lengths.count(texts, findall), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")
