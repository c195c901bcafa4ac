import os
import pickle

import pytest
from pyspark.sql.types import _parse_datatype_string

from logweave.errors import BatchFull, Corruption, InvalidArgument
from logweave.functions import codec
from logweave.operators import batch as batch_module
from logweave.operators.batch import LogBatch
from logweave.sources import rawlog


def example() -> LogBatch:
    b = LogBatch()
    b.add_entries(7, 1, [b"x" * 10, b"", b"yz"])
    b.clean(7)
    b.put(7, b"key", b"value")
    b.delete(7, b"key2")
    b.add_entries(8, 5, [b"abc"] * 4)
    b.compact(8, (1 << 64) - 1)
    return b


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("threshold", [0, 1])
def test_batch_round_trip(version, threshold):
    data = rawlog.encode_batch(example(), 9, version, threshold)
    end, kind, _, items, lengths, block = rawlog.decode_batch(data, 0, 9, version)
    assert end == len(data) and kind == bool(threshold)
    assert [(i.region_id, i.kind, i.first_index, i.key, i.value) for i in items] == [(i.region_id, i.kind, i.first_index, i.key, i.value) for i in example().items]
    assert lengths[0] == [10, 0, 2] and rawlog.payloads_of(block, kind) == b"x" * 10 + b"yz" + b"abc" * 4
    if version == 2:
        with pytest.raises(Corruption):
            rawlog.decode_batch(data, 0, 10, version)


def test_every_changed_byte_is_noticed():
    data = rawlog.encode_batch(example(), 3, threshold=0)
    for i in range(len(data)):
        bad = data[:i] + bytes([data[i] ^ 0x55]) + data[i + 1 :]
        with pytest.raises((Corruption, codec.CodecFailure)):
            _, kind, _, items, lengths, block = rawlog.decode_batch(bad, 0, 3, 2)
            raw = rawlog.payloads_of(block, kind)
            assert sum(map(sum, lengths)) == len(raw) and kind != 0, "noticed"
            raise Corruption("lengths")


def test_source_reads_dumps_and_recovers(spark, tmp_path):
    rawlog.register(spark)
    w = rawlog.RawLogWriter(str(tmp_path), 0, target_file_size=200)
    for i in range(6):
        b = LogBatch()
        b.add_entries(1, 1 + 3 * i, [bytes([i]) * 40] * 3)
        b.put(2, b"k%d" % i, b"v")
        assert w.write(b) > 0
    assert w.write(LogBatch()) == 0 and w.seq > 1
    r = rawlog.RawLogWriter(str(tmp_path), 1)
    b = LogBatch()
    b.add_entries(9, 4, [b"old"])
    r.write(b)
    (tmp_path / "0000000000000007.raftlog.reserved").write_bytes(b"\0" * 10)
    read = lambda **o: spark.read.format("raw_log").options(path=str(tmp_path), **o).load()
    rows = read().orderBy("lsn").collect()
    assert len(rows) == 13 and rows[0].queue == 1 and [int(x.first_index) for x in rows if x.kind == "ENTRIES"] == [4, 1, 4, 7, 10, 13, 16]
    assert bytes(rows[1].payloads[0]) == b"\0" * 40
    assert read().where("queue = 1").count() == 1
    # a fault in the middle of an old file: dump goes on behind it, recovery refuses it, 'any' tolerates it
    path = tmp_path / rawlog.file_name(0, 1)
    data = bytearray(path.read_bytes())
    data[-3] ^= 1
    path.write_bytes(data)
    dumped = read().collect()
    assert sum(x.error is not None for x in dumped) == 1 and len(dumped) < 14
    with pytest.raises(Exception, match="checksum"):
        read(mode="tolerate-tail-corruption").count()
    assert read(mode="tolerate-any-corruption").count() == len(dumped) - 1
    path.write_bytes(bytes(data[:-3]) + bytes([data[-3] ^ 1]) + bytes(data[-2:]))
    # the newest file's tail may be cut short
    last = tmp_path / rawlog.file_name(0, w.seq)
    last.write_bytes(last.read_bytes()[:-5])
    assert read(mode="tolerate-tail-corruption").count() < 13
    with pytest.raises(Exception, match="beyond"):
        read(mode="absolute-consistency").count()


def test_file_names_and_gaps():
    assert rawlog.parse_file_name(rawlog.file_name(0, 12)) == (0, 12) and rawlog.parse_file_name(rawlog.file_name(1, 3)) == (1, 3)
    assert rawlog.parse_file_name("12.raftlog") is None and rawlog.parse_reserved_name("0000000000000007.raftlog.reserved") == 7
    files = [(1, 4, ""), (0, 1, ""), (0, 2, ""), (0, 4, ""), (0, 5, "")]
    assert rawlog.newest_without_gap(files) == [(1, 4, ""), (0, 4, ""), (0, 5, "")]
    with pytest.raises(Corruption):
        rawlog.parse_header(b"no" * 40)
    assert rawlog.parse_header(rawlog.header(1))[0] == 1 and rawlog.parse_header(rawlog.header(2, 512))[:2] == (2, 512)


def test_builder_limits(monkeypatch):
    monkeypatch.setattr(batch_module, "MAX_BYTES", 10)
    b = LogBatch()
    b.add_entries(1, 1, [b"12345"])
    with pytest.raises(BatchFull):
        b.add_entries(1, 2, [b"123456"])
    assert len(b.items) == 1 and b.payload_bytes == 5
    for f in (lambda: b.put(1, b"__\x01", b""), lambda: b.delete(1, b"__\x01")):
        with pytest.raises(InvalidArgument):
            f()
    other = LogBatch()
    other.add_entries(2, 1, [b"12345"])
    b.merge(other)
    assert other.is_empty() and len(b.items) == 2 and b.approximate_size() > 10 and other.approximate_size() == 0
    assert [r[4] for r in b.rows(3, 0, 1, 100)] == [0, 1]


def test_compression():
    assert rawlog.decompress(rawlog.compress(b"abc" * 1000)) == b"abc" * 1000 and rawlog.decompress(b"") == b"" == rawlog.compress(b"")
    for bad in (b"ab", b"\x10\0\0\0\xff\xff"):
        with pytest.raises(Corruption):
            rawlog.decompress(bad)
    assert rawlog.zero_padded(b"") and rawlog.zero_padded(b"\0x\0") and not rawlog.zero_padded(b"\0x")
    assert os.path.basename(rawlog.file_name(1, 1)).endswith(".rewrite")


def recovered(spark, folder, mode, **options):
    rawlog.register(spark)
    return spark.read.format("raw_log").options(path=str(folder), mode=mode, **options).load()


def test_order_of_a_large_batch(spark, tmp_path):
    """lsn is distinct and in order of file, place and item whatever the size of a batch."""
    w = rawlog.RawLogWriter(str(tmp_path), 0, target_file_size=1000)
    for _ in range(2):
        b = LogBatch()
        for i in range(5000):
            b.compact(i % 3, i)
        w.write(b)
    rows = recovered(spark, tmp_path, "dump").select("file_seq", "block_offset", "item_no", "lsn").collect()
    places = [tuple(r)[:3] for r in sorted(rows, key=lambda r: r.lsn)]
    assert len({r.lsn for r in rows}) == 10_000 and places == sorted(places)
    assert rawlog.order_key(1, 9, 0, 0) < rawlog.order_key(0, 1, 0, 0) < rawlog.order_key(0, 1, (1 << 36) - 1, 0) < rawlog.order_key(0, 2, 0, 0) < 1 << 63
    for bad in ((0, 1 << 26, 0, 0), (0, 1, 1 << 36, 0)):
        with pytest.raises(InvalidArgument):
            rawlog.order_key(*bad)


@pytest.fixture
def three_files(tmp_path):
    w = rawlog.RawLogWriter(str(tmp_path), 0, target_file_size=100)
    for i in range(3):
        for j in range(2):
            b = LogBatch()
            b.add_entries(1, 1 + 4 * i + 2 * j, [b"a" * 20, b"b" * 20])
            if j:
                with open(w.file, "ab") as f:
                    f.write(rawlog.encode_batch(b, w.seq))
            else:
                w.write(b)
    return tmp_path


def damage(folder, seq, from_end):
    path = folder / rawlog.file_name(0, seq)
    data = bytearray(path.read_bytes())
    data[-from_end] ^= 1
    path.write_bytes(data)


MODES = ("absolute-consistency", "tolerate-tail-corruption", "tolerate-any-corruption")


@pytest.mark.parametrize("seq", [1, 3])
def test_broken_entries_at_a_tail(spark, three_files, seq):
    """The last batch of any file is dropped if its entries are broken, in every mode but absolute."""
    damage(three_files, seq, 30)  # within the entries block of the last batch
    for mode in MODES[1:]:
        assert sorted(r.first_index for r in recovered(spark, three_files, mode, payloads="false").collect()) == [i for i in (1, 3, 5, 7, 9, 11) if i != 4 * seq - 1]
    with pytest.raises(Exception, match="entries"):
        recovered(spark, three_files, MODES[0], payloads="false").count()


@pytest.mark.parametrize("seq", [1, 3])
def test_broken_items_at_a_tail(spark, three_files, seq):
    """A batch that can't be decoded is tolerated in the newest file only, and anywhere in tolerate-any mode; a filter on
    files doesn't change that."""
    damage(three_files, seq, 2)
    left = 5
    assert recovered(spark, three_files, MODES[2]).count() == left
    for filtered in (False, True):
        df = recovered(spark, three_files, MODES[1])
        df = df.where(f"file_seq = {seq}") if filtered else df
        if seq == 3:
            assert df.count() == (1 if filtered else left)
        else:
            with pytest.raises(Exception, match="checksum"):
                df.count()
    with pytest.raises(Exception, match="unknown mode"):
        recovered(spark, three_files, "tolerate").count()


def test_broken_entries_in_the_middle(spark, three_files):
    """Recovery doesn't look at entries before a file's last batch unless payloads are asked for."""
    n = len(rawlog.encode_batch(next(iter([_batch()])), 1))
    damage(three_files, 1, n + 30)
    assert recovered(spark, three_files, MODES[0], payloads="false").count() == 6
    with pytest.raises(Exception, match="entries"):
        recovered(spark, three_files, MODES[1]).collect()
    assert sum(r.payloads is None for r in recovered(spark, three_files, MODES[2]).collect()) == 1


def _batch():
    b = LogBatch()
    b.add_entries(1, 1, [b"a" * 20, b"b" * 20])
    return b


def test_spill_folder_uris_and_ratio(spark, tmp_path):
    main, spill = tmp_path / "main", tmp_path / "spill"
    w = rawlog.RawLogWriter(str(main), 0, target_file_size=100, threshold=8)
    w.write(_batch())
    second = rawlog.RawLogWriter(str(spill), 0, target_file_size=100, threshold=8)
    second.seq = 1
    second.rotate()
    b = LogBatch()
    b.add_entries(1, 3, [b"x" * 4000])
    second.write(b)
    os.remove(spill / rawlog.file_name(0, 1))
    assert 0 < second.compression_ratio < 0.1
    both = recovered(spark, f"file://{main}", "absolute-consistency", spill=f"file://{spill}")
    assert [int(r.first_index) for r in both.orderBy("lsn").collect()] == [1, 3]
    assert recovered(spark, main / rawlog.file_name(0, 1), "dump").count() == 1


def test_table_as_raw_files(spark, tmp_path):
    rows = [(0, 1 + i // 4, i, i // 2, i % 2, 7, "ENTRIES", i, i, None, None, [b"p%d" % i]) for i in range(10)]
    items = spark.createDataFrame(rows, batch_module.SCHEMA)
    files = rawlog.write_table(items, f"file://{tmp_path}/raw", threshold=1).collect()
    assert {r.file_seq for r in files} == {1, 2, 3} and all(r.raw_bytes and r.stored_bytes for r in files)
    back = recovered(spark, tmp_path / "raw", "absolute-consistency").orderBy("lsn").collect()
    assert [bytes(r.payloads[0]) for r in back] == [b"p%d" % i for i in range(10)]


def test_small_files_share_tasks(spark, tmp_path):
    """The number of tasks grows with the bytes of a log and not with its files, and a task isn't sent the names of all files."""
    n = 300
    for seq in range(1, n + 1):
        (tmp_path / rawlog.file_name(0, seq)).write_bytes(rawlog.header() + rawlog.encode_batch(_batch(), seq))
    (tmp_path / rawlog.file_name(0, 7)).write_bytes(rawlog.header() + rawlog.encode_batch(_batch(), 7)[:-1])
    df = recovered(spark, tmp_path, "dump")
    rows = df.collect()
    assert df.rdd.getNumPartitions() <= 2 * rawlog.LEAST_PARTS
    assert [r.file_seq for r in rows] == list(range(1, n + 1)) and [r.file_seq for r in rows if r.error] == [7]
    assert all(r.region_id == 1 and [bytes(p) for p in r.payloads] == [b"a" * 20, b"b" * 20] for r in rows if not r.error)
    reader = recovered_reader(tmp_path)
    assert len(pickle.dumps(reader)) < 10_000 and len(reader.files) == n
    assert [f[1] for p in reader.partitions() for f in p.files] == list(range(1, n + 1))


def recovered_reader(folder):
    return rawlog.RawLogSource({"path": str(folder)}).reader(_parse_datatype_string(rawlog.SCHEMA))


def test_log_without_files(spark, tmp_path):
    items = spark.createDataFrame([], batch_module.SCHEMA)
    assert rawlog.write_table(items, f"file://{tmp_path}/raw").collect() == []
    for mode in ("dump", *MODES):
        assert recovered(spark, tmp_path / "raw", mode).collect() == []


def test_batches_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(rawlog, "BATCH_BYTES", 100)
    schema = recovered_reader(tmp_path).schema
    rows = [(0, 1, i, 0, i, 1, "ENTRIES", i, i + 1, None, None, [20, 20], [b"a" * 20, b"b" * 20], 0, None) for i in range(10)]
    batches = list(rawlog.arrow_batches(iter(rows), schema))
    assert [b.num_rows for b in batches] == [3, 3, 3, 1] and [x for b in batches for x in b["lsn"].to_pylist()] == list(range(10))


def test_chunks_of_raw_files():
    """Neighbouring files of a raw log are folded in one chunk, of about as many operations as any chunk has."""
    from logweave.operators import fold
    from logweave.plans.queries import RAW_CHUNK
    from logweave.sources.derived import FILE_ROWS

    files = fold.CHUNK // FILE_ROWS
    at = [rawlog.order_key(0, seq, 64, 0) // RAW_CHUNK for seq in range(files, 3 * files)]
    assert len(set(at)) <= 3 and at == sorted(at)
