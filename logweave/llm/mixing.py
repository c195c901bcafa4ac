"""Mixing sources to target weights by temperature.

The token share p of each source is raised to an exponent and normalised to its weight. Exponent 1
keeps the natural mix, 0 makes all sources equal. The exponent is bisected to the largest at which
the weights have the target entropy (a share of the entropy of equal weights), or, where that would
repeat some source more often than the limit allows, to the smallest that keeps within the limit.

The weights are realised as a budget of tokens. A source whose budget is k.f times its size passes
whole k times; the rest comes from a permutation of its blocks (of about ``block_docs`` documents,
dealt and ordered by hash): whole blocks in turn, and documents in hash order in the block in which
the budget runs out. A document is taken while fewer tokens than the budget came before it.

Per source only block sums are ordered, and of one block its own documents; what follows is one row a
source: the weight, the whole passes and the last document that the last pass takes. Each document is
judged by that row where it lies, so texts are never shuffled and the hottest source is no task's work.

Defined results: tokens are runs of characters outside ASCII white space; null texts have none; a
null source counts as the source ''; sources without tokens have weight 0 and no copies; documents
without tokens go with the tokens before them; rows of one doc_id and equally many tokens stand at one
place and are taken together or not; a null doc_id counts as the smallest; extra columns are ignored
(``realise`` keeps them, but for those of its own names); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialise

#: Sources whose totals may be collected to bisect on the driver; beyond, each step of the bisection is a Spark aggregate.
LOCAL_SOURCES = 100_000


@dataclass(frozen=True)
class Target:
    """Even sources as far as no token is repeated more than 1.25 times: a mix that no natural corpus has."""

    entropy_share: float = 0.9999
    max_repeats: float = 1.25
    budget_share: float = 1.0  # budget as a share of all tokens


WORD = r"[^\x20\x09-\x0D]+"
_NULL_ID = -(1 << 63)


def count_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, source (null as '') and tokens of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source().alias("source"), _tokens().alias("tokens"))


def _source() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def _tokens() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def _hash(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts as text, which SQL has too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(x.cast("string") for x in parts)).cast("binary")), 1, 15), 16, 10).cast("long")


def measures(sources: DataFrame):
    """A function of the exponent: (entropy, largest weight / share) of the weights of ``sources`` (column p, over 0)."""
    if sources.count() <= LOCAL_SOURCES:
        p = np.array([r.p for r in sources.select("p").collect()])

        def local(exponent: float) -> tuple[float, float]:
            w = p**exponent / (p**exponent).sum()
            return float(-(w * np.log(w)).sum()), float((w / p).max())

        return local

    def spread(exponent: float) -> tuple[float, float]:
        x = F.pow("p", F.lit(exponent))
        r = sources.agg(F.sum(x).alias("z"), F.sum(x * F.log(x)).alias("xlx"), F.max(x / F.col("p")).alias("most")).first()
        return float(np.log(r.z) - r.xlx / r.z), r.most / r.z

    return spread


def bisect(ok, steps: int = 50) -> float:
    """The largest exponent in [0, 1] for which ``ok`` holds, where it holds up to some exponent; 0 if never."""
    if ok(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def solve(of, n_sources: int, target: Target) -> float:
    """The exponent for the target; ``of`` gives (entropy, weight / share at most) for an exponent."""
    if n_sources < 2:
        return 1.0
    exponent = bisect(lambda a: of(a)[0] >= target.entropy_share * np.log(n_sources))
    repeats = lambda a: of(a)[1] * target.budget_share
    if repeats(exponent) <= target.max_repeats or target.budget_share > target.max_repeats:
        return exponent if target.budget_share <= target.max_repeats else 1.0
    lo, hi = exponent, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if repeats(mid) <= target.max_repeats else (mid, hi)
    return hi


def _place(rows: DataFrame, seed: int) -> DataFrame:
    """Adds block, turn and place, by doc_id, source and n_blocks."""
    key = F.coalesce("doc_id", F.lit(_NULL_ID))
    rows = rows.withColumn("block", _hash(F.lit(seed), key) % F.coalesce("n_blocks", F.lit(1)))
    return rows.withColumns({"place": _hash(F.lit(seed + 1), key), "turn": _hash(F.lit(seed + 2), F.col("source"), F.col("block"))})


def plan(rows: DataFrame, target: Target, block_docs: int, seed: int) -> DataFrame:
    """A row for each source: weight, exponent, passes, n_blocks, n (rows) and ``last``, the place (turn, block, place, doc, tokens)
    of the last document of the last pass, null where that takes none."""
    sources = materialise(rows.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("n")), "sources")
    whole, k = sources.where("total > 0").agg(F.sum("total"), F.count("*")).first()
    shares = sources.where("total > 0").withColumn("p", F.col("total") / F.lit(float(whole or 1)))
    exponent = solve(measures(shares), k, target) if k else 1.0
    z = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0] or 1.0
    weighed = shares.withColumn("weight", F.pow("p", F.lit(exponent)) / F.lit(z)).withColumn("quota", F.round(F.col("weight") * F.lit(float((whole or 0) * target.budget_share))).cast("long"))
    weighed = weighed.select("source", "n", "weight", F.floor(F.col("quota") / F.col("total")).cast("long").alias("passes"), F.ceil(F.col("n") / F.lit(block_docs)).cast("long").alias("n_blocks"), F.pmod("quota", "total").alias("rest"))
    weighed = materialise(weighed, "weights")
    total = rows.count()
    placed = _place(_joined(rows, weighed.select("source", "n", "n_blocks", "rest"), total), seed)
    sums = placed.where("rest > 0").groupBy("source", "block", "turn").agg(F.sum("tokens").alias("size"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("turn", "block")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("before", before).where("before < rest").groupBy("source").agg(F.max(F.struct("turn", "block", (F.col("rest") - F.col("before")).alias("room"))).alias("c"))
    cut = cut.select("source", "c.turn", "c.block", "c.room")  # a row a source
    mine = placed.join(cut, ["source", "turn", "block"]).groupBy("source", "turn", "block", "room", "place", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), "tokens").agg(F.sum("tokens").alias("size"))
    inside = Window.partitionBy("source").orderBy("place", "doc", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    taken = mine.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).where("before < room")
    last = taken.groupBy("source").agg(F.max(F.struct("turn", "block", "place", "doc", "tokens")).alias("last"))
    return materialise(weighed.join(last, "source", "left").select("source", "n", "weight", "passes", "n_blocks", F.lit(exponent).alias("exponent"), "last"), "plan")


def _joined(rows: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """``rows`` with the facts of their source; those without tokens have none."""
    names = [c for c in facts.columns if c not in ("source", "n")]
    if facts.count() <= LOCAL_SOURCES:
        return rows.join(F.broadcast(facts.drop("n")), "source", "left")
    known = join_counted(rows.join(facts.select("source"), "source", "left_semi"), facts, ["source"], "n", total)
    return known.unionByName(rows.join(facts.select("source"), "source", "left_anti").select("*", *(F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in names)))


def _copies(rows: DataFrame, facts: DataFrame, seed: int) -> DataFrame:
    placed = _place(_joined(rows, facts, rows.count() if facts.count() > LOCAL_SOURCES else 0), seed)
    own = F.struct("turn", "block", "place", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc"), "tokens")
    more = F.coalesce((own <= F.col("last")).cast("long"), F.lit(0))
    return placed.withColumns({"copies": F.coalesce("passes", F.lit(0)) + more, "weight": F.coalesce("weight", F.lit(0.0)), "exponent": F.coalesce("exponent", F.lit(1.0))})


COLUMNS = ["tokens", "weight", "copies", "exponent", "turn", "block", "place"]


def mix(docs: DataFrame, target: Target = Target(), block_docs: int = 4096, seed: int = 1) -> DataFrame:
    """doc_id, source, tokens, weight (of its source), copies, exponent, turn, block and place of each row of ``docs``.

    Within a source (turn, block, place, doc_id, tokens) is the order of each pass: blocks by turn, in each its documents by place.
    """
    rows = materialise(count_tokens(docs), "tokens")
    return _copies(rows, plan(rows, target, block_docs, seed), seed).select("doc_id", "source", *COLUMNS)


def realise(docs: DataFrame, target: Target = Target(), block_docs: int = 4096, seed: int = 1) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, as often as they are taken, with tokens, weight, copies, exponent,
    turn, block, place and ``copy`` (the pass, from 1 on). Texts stay where they lie."""
    rows = materialise(count_tokens(docs), "tokens")
    facts = plan(rows, target, block_docs, seed)
    names = [c for c in docs.columns if c not in (*COLUMNS, "copy")]
    kept = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), _source().alias("source"), _tokens().alias("tokens"))
    taken = _copies(kept, facts, seed).where("copies > 0")
    return taken.select("_row.*", *COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
