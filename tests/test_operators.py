import struct
import warnings

import pytest
from pyspark.sql import functions as F

from logweave import config
from logweave.errors import InvalidArgument
from logweave.functions import codec
from logweave.functions.columns import INTERNAL_KEY, MAX_INDEX
from logweave.operators import fold, gc, integrity, reads
from logweave.operators import state as S
from logweave.plans.filters import keep_recent

from .test_fold import SCHEMA, one, rows

RUNS = "region_id long, lsn long, queue tinyint, file_seq long, lo long, hi long"


def df(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_fetch_rules(spark):
    items = df(spark, rows(one(("ENTRIES", 0, 24), ("COMPACT", 10, None)) + [(2, "PUT", None, None, b"k", b"v")]), SCHEMA)
    runs, known = fold.live_runs(items), fold.regions(items)
    asked = df(spark, [(1, 10, 25), (1, 5, 15), (1, 20, 30), (1, 7, 7), (2, 1, 2), (3, 1, 2), (1, 24, 25)], "region_id long, begin long, end long")
    got = {(r.region_id, r.begin, r.end): r.status for r in reads.fetch_status(asked, runs, known).collect()}
    assert got == {(1, 10, 25): "Ok", (1, 5, 15): "Compacted", (1, 20, 30): "NotFound", (1, 7, 7): "Ok", (2, 1, 2): "NotFound", (3, 1, 2): "Ok", (1, 24, 25): "Ok"}
    for (begin, end, most), n in {(10, 25, 10): 10, (20, 25, 0): 1, (20, 25, 99): 5}.items():
        request = df(spark, [(1, begin, end, most)], "region_id long, begin long, end long, max_size long")
        assert reads.fetch_entries(request, runs, F.lit(1)).count() == n
    compact = df(spark, [(1, 12), (1, 3), (1, 40), (2, 9)], "region_id long, index long")
    assert {r["index"]: r.removed for r in reads.compact_result(compact, runs).collect()} == {12: 2, 3: 0, 40: 30, 9: 0}


def test_scan_and_decode(spark):
    kvs = df(spark, [(1, b"k1", b"1"), (1, b"k5", b"x"), (1, b"\x7f", b"2"), (1, b"\x80", b"3")], "region_id long, key binary, value binary")
    keys = lambda **o: [bytes(r.key) for r in reads.kv_scan(kvs, **o).collect()]
    assert keys() == [b"k1", b"k5", b"\x7f", b"\x80"] and keys(reverse=True, limit=1) == [b"\x80"]
    assert keys(start=b"k5", end=b"\x80") == [b"k5", b"\x7f"] and keys(start=b"k1", end=b"k5") == [b"k1"]
    number = F.expr("try_cast(cast(value as string) as long)")
    assert reads.decode(kvs, number, strict=False).count() == 3
    with pytest.raises(Exception, match="can't parse"):
        reads.decode(kvs, number, strict=True).collect()


def test_internal_keys_make_no_region(spark):
    items = df(spark, rows([(1, "PUT", None, None, INTERNAL_KEY, b"\0")]), SCHEMA)
    assert fold.regions(items).count() == 0 and fold.live_kvs(items).count() == 0


def test_prefix_rules(spark):
    runs = df(spark, [(1, 1, 0, 2, 1, 5), (1, 2, 0, 9, 6, 8), (1, 3, 0, 3, 9, 12), (2, 4, 1, 1, 1, 3), (2, 5, 0, 4, 4, 6)], RUNS)
    assert {(r.lo, r.hi) for r in reads.entries_before(runs, 5).collect()} == {(1, 5), (4, 6)}
    moved = df(spark, [(1, 1, 7), (2, 2, 4)], "region_id long, first_index long, last_index long")
    got = sorted(tuple(r) for r in gc.apply_rewrite(runs, moved, 5, 7).select("region_id", "lo", "hi", "queue", "file_seq").collect())
    assert got == [(1, 1, 5, 1, 7), (1, 6, 8, 0, 9), (1, 9, 12, 0, 3), (2, 1, 1, 1, 1), (2, 2, 3, 1, 7), (2, 4, 4, 1, 7), (2, 5, 6, 0, 4)]
    free = sorted(tuple(r) for r in gc.apply_rewrite(runs, moved, None, 7).select("region_id", "lo", "hi", "queue", "file_seq").collect())
    assert (2, 2, 3, 1, 7) in free and (2, 4, 6, 0, 4) in free and (1, 1, 5, 0, 2) in free


def test_force_rewrite_after_ten_rounds(spark):
    runs = df(spark, [(1, 1, 0, 1, 1, 50), (2, 2, 0, 9, 1, 3)], RUNS)
    kvs = df(spark, [], "region_id long, key binary, value binary, queue tinyint, file_seq long, lsn long")
    state = S.region_state(runs.select("region_id").distinct(), runs, kvs)
    counters = None
    for turn in range(11):
        got = {r.region_id: r for r in gc.purge_candidates(state, runs, 7, 3, counters).collect()}
        assert got[1].should_compact and got[1].do_rewrite == (turn == 9) and not got[2].should_compact and not got[2].do_rewrite
        counters = df(spark, [(1, got[1].counter)], "region_id long, counter int")


def test_consistency_head_and_tail_unseen(spark):
    ops = [(r, "ENTRIES", i, i, None, None) for r in range(1, 11) for i in range(1, 101) if i != r * r]
    found = {r.region_id: r.last_valid for r in integrity.consistency_check(df(spark, rows(ops), SCHEMA)).collect()}
    assert found == {r: r * r - 1 for r in range(2, 10)}


def test_repair(spark):
    ops = one(("ENTRIES", 1, 4), ("ENTRIES", 8, 9), ("COMPACT", 9, None), ("ENTRIES", 10, 10), ("CLEAN", None, None), ("ENTRIES", 5, 6)) + [(2, "PUT", None, None, b"k", b"v")]
    kept = integrity.repair(df(spark, rows(ops), SCHEMA), keep_recent).orderBy("lsn", F.desc("inserted")).collect()
    assert [(r.lsn, r.kind, r.inserted) for r in kept] == [(0, "ENTRIES", False), (1, "COMPACT", True), (1, "ENTRIES", False), (2, "COMPACT", False), (3, "ENTRIES", False), (4, "CLEAN", False), (5, "ENTRIES", False), (6, "PUT", False)]
    assert kept[1].first_index == MAX_INDEX
    drop = integrity.repair(df(spark, rows(ops), SCHEMA), lambda region, view, queue, kind, a, b: int(kind == "ENTRIES"))
    assert {r.kind for r in drop.collect()} == {"COMPACT", "CLEAN", "PUT"}
    with pytest.raises(Exception, match="don't fit"):
        integrity.repair(df(spark, rows(ops), SCHEMA), lambda *a: 0).count()


def test_files(spark):
    files = df(spark, [(0, s) for s in (1, 2, 4, 5)] + [(1, 7)], "queue tinyint, file_seq long")
    assert {tuple(r) for r in integrity.trim_files(files).collect()} == {(0, 4), (0, 5), (1, 7)}
    assert {r.file_seq for r in integrity.fork_plan(files).where("how = 'copied'").collect()} == {5, 7}
    with pytest.raises(ValueError):
        integrity.fork_plan(files, recycles=True)


def test_config():
    c = config.EngineConfig().sanitize()
    assert c.purge_rewrite_threshold == 1 << 30 and c.recycle_capacity == 120 and c.prefill_capacity == 0
    assert config.EngineConfig(prefill_for_recycle=True).sanitize().prefill_capacity == 120
    for bad in (dict(purge_threshold=1), dict(format_version=1), dict(enable_log_recycle=False, prefill_for_recycle=True)):
        with pytest.raises(InvalidArgument):
            config.EngineConfig(**bad).sanitize()
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert config.EngineConfig(recovery_threads=0, recovery_read_block_size=1, bytes_per_sync=1, prefill_limit=3).sanitize().recovery_read_block_size == 512
    assert len(w) == 4
    c = config.EngineConfig.from_dict({"target-file-size": "1MB", "recovery-mode": "absolute-consistency"})
    assert c.target_file_size == 1 << 20 and c.recovery_mode is config.RecoveryMode.ABSOLUTE
    with pytest.raises(InvalidArgument):
        config.EngineConfig.from_dict({"nope": 1})


def test_sizes():
    assert [config.parse_size(x) for x in ("16KB", "1.5 GiB", "3", 7, "2M", "5B", "1e3")] == [16 << 10, 3 << 29, 3, 7, 2 << 20, 5, 1000]
    assert [config.format_size(x) for x in (0, 1, 1024, 3 << 29, 1 << 50)] == ["0KiB", "1B", "1KiB", "1536MiB", "1PiB"]
    for bad in ("", "x", "5 Q", "1KIB", "KB"):
        with pytest.raises(InvalidArgument):
            config.parse_size(bad)


def test_codecs():
    numbers = [0, 1, 127, 128, 300, (1 << 63) - 1, (1 << 64) - 1]
    for v in numbers:
        assert codec.Reader(codec.var_u64(v)).var_u64() == v and codec.unhash_u64(codec.hash_u64(v)) == v
        assert codec.from_ordered_u64(codec.ordered_u64(v)) == v == codec.from_ordered_u64(codec.ordered_u64(v, True), True)
    signed = [-(1 << 63), -300, -1, 0, 1, (1 << 63) - 1]
    floats = [float("-inf"), -1.5, -0.0, 1e-300, 2.5, float("inf")]
    for values, enc, dec in ((signed, codec.ordered_i64, codec.from_ordered_i64), (floats, codec.ordered_f64, codec.from_ordered_f64)):
        for down in (False, True):
            packed = [enc(v, down) for v in values]
            assert [dec(p, down) for p in packed] == values and sorted(packed, reverse=down) == packed
    for v in signed:
        assert codec.Reader(codec.var_i64(v)).var_i64() == v
    assert codec.hash_u64(1) == 0x5692161D100B05E5 and codec.crc32(b"123456789") == 3421780262
    assert codec.round_up(5, 4) == 8 and codec.round_down(5, 4) == 4
    assert codec.Reader(struct.pack("<I", 7)).number("<I") == 7 and codec.number("<H", 3) == b"\3\0"
    for bad in (b"", b"\x80", b"\xff" * 11):
        with pytest.raises(codec.CodecFailure):
            codec.Reader(bad).var_u64()
