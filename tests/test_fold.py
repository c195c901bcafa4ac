"""Folds against a sequential model of the same rules."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.operators import fold, integrity, recover
from logweave.operators import state as S
from logweave.streaming.ingest import apply_operation

SCHEMA = "queue tinyint, file_seq long, lsn long, region_id long, kind string, first_index long, last_index long, key binary, value binary"


def rows(ops, queue=0):
    """ops: (region, kind, first, last, key, value)."""
    return [(queue, 1 + i // 5, i, r, kind, a, b, key, value) for i, (r, kind, a, b, key, value) in enumerate(ops)]


class Region:
    """The live state of one region, operation by operation."""

    def __init__(self):
        self.entries, self.kvs, self.exists = {}, {}, False

    def apply(self, kind, a, b, key, value, lsn, holes=False):
        self.exists = kind != "CLEAN"
        if kind == "ENTRIES":
            if self.entries and holes and a > max(self.entries) + 1:
                self.entries = {}
            self.entries = {i: x for i, x in self.entries.items() if i < a} | dict.fromkeys(range(a, b + 1), lsn)
        elif kind == "COMPACT":
            self.entries = {i: x for i, x in self.entries.items() if i >= a}
        elif kind == "CLEAN":
            self.entries, self.kvs = {}, {}
        elif kind == "PUT":
            self.kvs[key] = value
        else:
            self.kvs.pop(key, None)


def sequential(ops, holes=False):
    out = {}
    for lsn, (r, kind, a, b, key, value) in enumerate(ops):
        out.setdefault(r, Region()).apply(kind, a, b, key, value, lsn, holes)
    return out


def script(rng, n, regions=3, holes=False):
    """A random script without holes or writes below the first index (unless holes are asked for)."""
    ops, state = [], {}
    for _ in range(n):
        r = rng.randrange(regions)
        s = state.setdefault(r, Region())
        kind = rng.choice(["ENTRIES"] * 4 + ["COMPACT", "PUT", "PUT", "DEL"] + ["CLEAN"] * (rng.random() < 0.3))
        a = b = key = value = None
        if kind == "ENTRIES":
            lo, hi = (min(s.entries), max(s.entries) + 1) if s.entries else (rng.randrange(1, 9),) * 2
            a = rng.randint(lo, hi) + (rng.randrange(3) if holes else 0)
            b = a + rng.randrange(4)
        elif kind == "COMPACT":
            a = rng.randrange(30)
        elif kind in ("PUT", "DEL"):
            key = b"k%d" % rng.randrange(4)
            value = b"v%d" % rng.randrange(100) if kind == "PUT" else None
        s.apply(kind, a, b, key, value, len(ops), holes)
        ops.append((r, kind, a, b, key, value))
    return ops


def entries(runs):
    return {(r.region_id, i): r.lsn for r in runs.collect() for i in range(r.lo, r.hi + 1)}


@pytest.mark.parametrize("seed", range(2))
def test_fold_equals_sequential(spark, seed):
    ops = script(random.Random(seed), 250, regions=6)
    items = spark.createDataFrame(rows(ops), SCHEMA).repartition(3)
    want = sequential(ops)
    expected = {(r, i): lsn for r, s in want.items() for i, lsn in s.entries.items()}
    for chunk in (7, fold.CHUNK):
        assert entries(fold.live_runs(items, chunk=chunk)) == expected
        assert entries(fold.live_runs(items, holes=True, chunk=chunk)) == expected
        assert fold.strict_violations(items, chunk).count() == 0
    assert {(r.region_id, bytes(r.key)): bytes(r.value) for r in fold.live_kvs(items).collect()} == {(r, k): v for r, s in want.items() for k, v in s.kvs.items()}
    assert {r.region_id for r in fold.regions(items).collect()} == {r for r, s in want.items() if s.exists}
    runs: dict[int, list] = {}
    for r, kind, a, b, _, _ in ops:
        runs[r] = apply_operation(runs.get(r, []), kind, a, b)
    assert {(r, i) for r, x in runs.items() for a, b in x for i in range(a, b + 1)} == set(expected)


@given(st.integers(0, 10**6))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_fold_with_holes(spark, seed):
    ops = script(random.Random(seed), 60, holes=True)
    items = spark.createDataFrame(rows(ops), SCHEMA)
    want = {(r, i): lsn for r, s in sequential(ops, True).items() for i, lsn in s.entries.items()}
    faults = {r.lsn: (r.expected_last, r.expected_first, r.reason) for r in fold.strict_violations(items).collect()}
    gaps = {r.region_id: r.last_valid for r in integrity.consistency_check(items).collect()}
    for chunk in (5,):
        assert entries(fold.live_runs(items, holes=True, chunk=chunk)) == want
        assert {r.lsn: (r.expected_last, r.expected_first, r.reason) for r in fold.strict_violations(items, chunk).collect()} == faults
        assert {r.region_id: r.last_valid for r in integrity.consistency_check(items, chunk).collect()} == gaps


def one(*ops):
    return [(1, kind, a, b, None, None) for kind, a, b in ops]


@pytest.mark.parametrize(
    "ops, expected",
    [
        (one(("ENTRIES", 10, 19), ("ENTRIES", 20, 29), ("ENTRIES", 25, 34)), range(10, 35)),
        (one(("ENTRIES", 0, 24), ("COMPACT", 5, None), ("COMPACT", 20, None), ("COMPACT", 15, None)), range(20, 25)),
        (one(("ENTRIES", 1, 4), ("CLEAN", None, None), ("ENTRIES", 2, 5), ("CLEAN", None, None), ("ENTRIES", 3, 6)), range(3, 7)),
        (one(("COMPACT", 50, None), ("ENTRIES", 3, 4)), range(3, 5)),
        (one(("ENTRIES", 1, 4), ("COMPACT", 100, None), ("ENTRIES", 2, 3)), range(2, 4)),
        (one(("ENTRIES", 0, 19), ("COMPACT", 18, None), ("ENTRIES", 20, 39), ("COMPACT", 38, None), ("ENTRIES", 40, 59)), range(38, 60)),
    ],
)
def test_scenarios(spark, ops, expected):
    assert sorted(i for _, i in entries(fold.live_runs(spark.createDataFrame(rows(ops), SCHEMA)))) == list(expected)


def test_strict_violations(spark):
    ops = one(("ENTRIES", 10, 19), ("ENTRIES", 21, 21), ("COMPACT", 21, None), ("ENTRIES", 20, 25), ("CLEAN", None, None), ("ENTRIES", 3, 3))
    found = fold.strict_violations(spark.createDataFrame(rows(ops), SCHEMA)).orderBy("lsn").collect()
    assert [(r.lsn, r.reason) for r in found] == [(1, "hole"), (3, "compacted")]


def staged(rewrite, append):
    """Sequential recovery: rewrite queue, then the append queue's tombstones, then the append queue's own state."""
    old, new = sequential(rewrite, True), sequential(append)
    for r, kind, a, b, key, value in append:
        if kind in ("CLEAN", "COMPACT", "DEL") and r in old:
            old[r].apply(kind, a, b, key, value, -1)
    out = {}
    for r in old.keys() | new.keys():
        o, n = old.get(r, Region()), new.get(r, Region())
        kept = dict(o.entries)
        if n.entries:
            first = min(n.entries)
            kept = {i: x for i, x in kept.items() if i < first} if kept and first <= max(kept) + 1 else {}
        out[r] = (set(kept) | set(n.entries), o.kvs | n.kvs)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_recovery_is_staged(spark, seed):
    rng = random.Random(seed)
    rewrite = [(r, kind, a, b, k, v) for r, kind, a, b, k, v in script(rng, 60, holes=True) if kind in ("ENTRIES", "PUT", "CLEAN")]
    append = script(rng, 60)
    r, a = spark.createDataFrame(rows(rewrite, 1), SCHEMA), spark.createDataFrame(rows(append), SCHEMA)
    want = staged(rewrite, append)
    for chunk in (9, fold.CHUNK):
        assert set(entries(recover.recover_runs(r, a, chunk))) == {(g, i) for g, (e, _) in want.items() for i in e}
    assert {(x.region_id, bytes(x.key)): bytes(x.value) for x in recover.recover_kvs(r, a).collect()} == {(g, k): v for g, (_, kv) in want.items() for k, v in kv.items()}


def test_recovery_differs_from_concatenation(spark):
    """Rewritten 1..10, appended 7..9, compact 10: staged recovery keeps entry 10."""
    r = spark.createDataFrame(rows([(1, "ENTRIES", 1, 10, None, None)], 1), SCHEMA)
    a = spark.createDataFrame(rows(one(("ENTRIES", 7, 9), ("COMPACT", 10, None))), SCHEMA)
    assert sorted(i for _, i in entries(recover.recover_runs(r, a))) == [10]


def test_atomic_groups(spark):
    b, m, e = 0, 1, 2
    cases = {1: [b, e], 2: [b, m, m, e], 3: [m, e], 4: [b, b, e], 5: [b, m], 6: [b, e, e, m, b, e], 7: [e, b, m, b, m, e]}
    want = {1: [0, 1], 2: [0, 1, 2, 3], 3: [], 4: [1, 2], 5: [], 6: [0, 1, 4, 5], 7: [3, 4, 5]}
    df = spark.createDataFrame([(g, i, s) for g, x in cases.items() for i, s in enumerate(x)], "group_id long, lsn long, status int")
    got = recover.atomic_groups(df).where("accepted").collect()
    assert {g: sorted(r.lsn for r in got if r.group_id == g) for g in cases} == want
    marked = spark.createDataFrame([(1, True), (2, False)], "batch_id long, accepted boolean")
    assert recover.only_whole_groups(spark.createDataFrame([(1,), (2,), (3,)], "batch_id long"), marked).count() == 2


def hot_log(spark, n=4000):
    """Nine of ten rows are of one region."""
    region = F.when(F.col("id") % 10 > 0, F.lit(0)).otherwise(F.col("id") % 7 + 1)
    return spark.range(n).select(F.lit(0).cast("tinyint").alias("queue"), (1 + F.col("id") / 100).cast("long").alias("file_seq"), F.col("id").alias("lsn"), region.alias("region_id"), F.lit("ENTRIES").alias("kind"), F.col("id").alias("first_index"), (F.col("id") + 20).alias("last_index"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"))


def test_hot_region_is_spread(spark):
    """One region with most of all rows is dealt over tasks, and rows are shuffled once."""
    items = hot_log(spark)
    assert max(r["count"] for r in fold.chunked(items, 100).groupBy(*fold.BY).count().collect()) <= 100
    runs = fold.live_runs(items, chunk=100)
    assert {(r.region_id, r.lo, r.hi) for r in runs.collect()} == {(r.region_id, r.lo, r.hi) for r in fold.live_runs(items).collect()}
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [region_id") == 2  # the same exchange, read twice
    n = spark.createDataFrame([(0, 1), (0, 1500), (3, 2), (0, 10**6)], "region_id long, n long")
    assert sorted(map(tuple, S.nth_entry_seq(runs, n, chunk=64).collect())) == sorted(map(tuple, S.nth_entry_seq(runs, n).collect()))
