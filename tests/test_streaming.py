"""Live runs as streaming state."""

import os
import random
from collections import deque

import pytest

from logweave.plans import queries
from logweave.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_operations_against_sets():
    rng = random.Random(5)
    for _ in range(200):
        runs, live, end = deque(), set(), 0
        for _ in range(40):
            kind = rng.choice(["ENTRIES"] * 6 + ["COMPACT", "COMPACT", "PUT", "CLEAN"])
            first = max(0, end + 1 - rng.randrange(6)) if kind != "COMPACT" else max(0, end - rng.randrange(12))
            last = first + rng.randrange(4)
            ingest.apply_operation(runs, kind, first, last)
            if kind == "ENTRIES":
                live, end = {i for i in live if i < first} | set(range(first, last + 1)), last
            elif kind == "COMPACT":
                live = {i for i in live if i >= first}
            elif kind == "CLEAN":
                live = set()
            assert [i for a, b in runs for i in range(a, b + 1)] == sorted(live) and all(a <= b for a, b in runs)


def test_large_indexes_beside_nulls(spark, tmp_path):
    """Indexes that floats can't hold, in a batch with operations that have none."""
    big = (1 << 53) + 1
    rows = [(7, 1, "ENTRIES", big, big + 2), (7, 2, "PUT", None, None), (7, 3, "COMPACT", big + 1, None)]
    items = spark.createDataFrame(rows, "region_id long, lsn long, kind string, first_index long, last_index long")
    items.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in")
    got = []
    ingest.live_state(source).writeStream.outputMode("update").foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in got] == [(7, big + 1, big + 2, 2, 3)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_steps_are_many_tasks_work(spark, tmp_path, monkeypatch):
    """Every step's part of the log is written by several tasks and read in one micro-batch."""
    monkeypatch.setattr(ingest, "scratch", lambda spark, name: str(tmp_path / name))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, ingest.streamed_state(spark, SF).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted(map(tuple, queries.QUERIES["first_last_index"](spark, SF).collect()))
    assert len(list((tmp_path / "stream/in").glob("*.parquet"))) > 2 * 4
    assert len(list((tmp_path / "stream/checkpoint/commits").glob("[0-9]*"))) == 4
