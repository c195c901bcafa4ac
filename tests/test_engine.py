import json

import pytest

from logweave.__main__ import main
from logweave.config import EngineConfig
from logweave.errors import DecodeFailure, EntryCompacted, EntryNotFound
from logweave.operators.batch import LogBatch
from logweave.plans.engine import LogEngine
from logweave.plans.filters import keep_recent


def batch(*calls):
    b = LogBatch()
    for name, *args in calls:
        getattr(b, name)(*args)
    return b


def test_write_read_purge_reopen(spark, tmp_path, capsys):
    path = str(tmp_path / "log")
    e = LogEngine(spark, path, EngineConfig(target_file_size=1, purge_threshold=3, purge_rewrite_threshold=1))
    seen = []
    e.listeners.append(lambda *x: seen.append(x))
    assert e.is_empty() and e.write(LogBatch()) == 0
    e.write(batch(("add_entries", 1, 1, [b"a%d" % i for i in range(10)]), ("put", 1, b"k", b"7")), batch(("add_entries", 2, 5, [b"b"] * 3), ("put", 2, b"x", b"?")))
    e.write(batch(("add_entries", 1, 8, [b"c%d" % i for i in range(5)]), ("clean", 2)))
    e.write(batch(("put", 1, b"m", b"not json"), ("compact", 1, 3)))
    assert e.region_ids() == [1] and (e.first_index(1), e.last_index(1)) == (3, 12) and e.first_index(2) is None
    assert e.fetch_entries(1, 6, 10) == [b"a5", b"a6", b"c0", b"c1"] and e.fetch_entries(1, 6, 10, 3) == [b"a5"] and e.fetch_entries(9, 1, 2) == []
    assert e.get_entry(1, 8) == b"c0" and e.get_entry(1, 99) is None and e.get(1, b"k") == b"7" and e.get(2, b"x") is None
    with pytest.raises(EntryCompacted):
        e.fetch_entries(1, 1, 4)
    with pytest.raises(EntryNotFound):
        e.fetch_entries(1, 5, 99)
    assert e.get_message(1, b"k", json.loads) == 7 and e.get_message(1, b"none", json.loads) is None
    with pytest.raises(DecodeFailure):
        e.get_message(1, b"m", json.loads)
    got = []
    e.scan_messages(1, json.loads, lambda k, v: got.append((k, v)) or True)
    assert got == [(b"k", 7)]
    e.scan(1, lambda k, v: got.append(k) and False, reverse=True)
    assert got[-1] == b"m" and len(got) == 2
    assert e.compact_to(1, 5) == 2 and e.compact_to(7, 5) == 0
    before = e.fetch_entries(1, 5, 13)
    e.must_rewrite_append_queue()
    assert e.must_purge_all_stale() > 0 and any(x[0] == "purged" for x in seen)
    again = LogEngine(spark, path)
    assert again.fetch_entries(1, 5, 13) == before and again.get(1, b"k") == b"7" and again.get(2, b"x") is None
    again.must_rewrite_rewrite_queue()
    assert again.fetch_entries(1, 5, 13) == before and again.used_size() > 0
    assert isinstance(e.purge_expired_files(), list) and again.fetch_entries(1, 5, 13) == before
    assert again.fork(str(tmp_path / "fork")).count() >= 2 and LogEngine(spark, str(tmp_path / "fork")).fetch_entries(1, 5, 13) == before
    again.write(batch(("add_entries", 1, 50, [b"far"])), batch(("add_entries", 1, 60, [b"farther"])))
    assert [tuple(r) for r in again.consistency_check().collect()] == [(1, 50)]
    fixed = again.repair(keep_recent, str(tmp_path / "fixed"))
    assert (fixed.first_index(1), fixed.last_index(1)) == (60, 60)
    main(["dump", "--path", path, "-r", "1"])
    main(["check", "--path", path])
    assert "last valid index 50" in capsys.readouterr().out
