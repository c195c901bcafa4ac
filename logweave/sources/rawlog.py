"""Raw log files: encoder, writer with rotation, and a Python Data Source that reads a directory.

A file is a header (magic, version, for version 2 an alignment) and batches. A batch is a header of
two big-endian words (length << 8 | compression; place of the footer), the entries block (payloads,
perhaps LZ4, then CRC-32) and the footer (number of items, items, CRC-32 signed with the file number).

Folders are local paths or URIs of any file system that pyarrow opens; a log may lie in a main and a
spill folder. ``lsn`` orders all rows: rewrite queue first, then file, then place in the file. An item is at
least three bytes long, so that a batch's place plus the item's number never reaches the next batch.
"""

from __future__ import annotations

import itertools
import os
import re
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import RecoveryMode
from ..errors import CodecFailure, Corruption, InvalidArgument, LogError
from ..functions.codec import Reader, crc32, round_up, var_u64
from ..operators.batch import Item, LogBatch

# fixed values: the file format
MAGIC = b"RAFT-LOG-FILE-HEADER-9986AB3E47F320B394C8E84916EB0ED5"
SUFFIXES = {0: ".raftlog", 1: ".rewrite"}
RESERVED_SUFFIX = ".raftlog.reserved"
SEQ_WIDTH = 16
ENTRIES, COMMAND, KV = 1, 2, 3
CLEAN, COMPACT = 1, 2
PUT, DEL = 1, 2
PLAIN, LZ4 = 0, 1

#: Bits of a place in a file and of a file's number in ``lsn``.
OFFSET_BITS, SEQ_BITS = 36, 26
DUMP = "dump"

#: Files of a log are read together, up to so many bytes a task, each with what opening it costs; but in at least so many tasks.
PART_BYTES, OPEN_BYTES, LEAST_PARTS = 32 << 20, 64 << 10, 32
#: Rows, and bytes of keys, values and payloads, of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20

SCHEMA = "queue tinyint, file_seq long, block_offset long, item_no int, lsn long, region_id decimal(20,0), kind string, first_index decimal(20,0), last_index decimal(20,0), key binary, value binary, entry_len array<long>, payloads array<binary>, compression tinyint, error string"


def file_name(queue: int, seq: int) -> str:
    return f"{seq:0{SEQ_WIDTH}d}{SUFFIXES[queue]}"


def parse_file_name(name: str) -> tuple[int, int] | None:
    """(queue, file number) of a log file's name; None for any other."""
    m = re.fullmatch(r"(\d{16})(\.raftlog|\.rewrite)", name)
    return ({v: k for k, v in SUFFIXES.items()}[m[2]], int(m[1])) if m else None


def parse_reserved_name(name: str) -> int | None:
    m = re.fullmatch(r"(\d{16})\.raftlog\.reserved", name)
    return int(m[1]) if m else None


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a local path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path) else (pafs.LocalFileSystem(), path)


def scan_sizes(*paths: str) -> list[tuple[int, int, str, int]]:
    """(queue, file number, path, bytes) of the log files of one or more folders, rewrite files first, each queue in order."""
    found = []
    for path in paths:
        fs, inside = open_fs(path)
        prefix = path.rstrip("/")
        found += [(*p, f"{prefix}/{i.base_name}", i.size or 0) for i in fs.get_file_info(pafs.FileSelector(inside)) if i.is_file and (p := parse_file_name(i.base_name))]
    return sorted(found, key=lambda f: (-f[0], f[1]))


def scan_dir(*paths: str) -> list[tuple[int, int, str]]:
    """(queue, file number, path) of the log files of one or more folders, rewrite files first, each queue in order."""
    return [f[:3] for f in scan_sizes(*paths)]


def newest_without_gap(files: list[tuple]) -> list[tuple]:
    """Each queue's newest files with consecutive numbers."""
    kept: dict[int, int] = {}
    for q, seq, *_ in reversed(files):
        if q not in kept or kept[q] == seq + 1:
            kept[q] = seq
    return [f for f in files if f[1] >= kept[f[0]]]


def order_key(queue: int, seq: int, at: int, no: int) -> int:
    """``lsn`` of item ``no`` of the batch at ``at``; refuses what doesn't fit."""
    if seq >> SEQ_BITS or (at + no) >> OFFSET_BITS:
        raise InvalidArgument(f"file {seq}, place {at}: too large for an order key")
    return (1 - queue) << (OFFSET_BITS + SEQ_BITS) | seq << OFFSET_BITS | at + no


def zero_padded(data: bytes) -> bool:
    return not data or (data[0] == 0 and data[-1] == 0)


def compress(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + bytes(pa.Codec("lz4_raw").compress(data)) if data else b""


def decompress(data: bytes) -> bytes:
    if not data:
        return b""
    if len(data) <= 4:
        raise Corruption(f"compressed block of {len(data)} bytes")
    n = struct.unpack("<I", data[:4])[0]
    try:
        out = bytes(pa.Codec("lz4_raw").decompress(data[4:], n))
    except (OSError, pa.ArrowException) as e:
        raise Corruption(f"decompression failed: {e}") from e
    if len(out) != n:
        raise Corruption(f"{len(out)} bytes decompressed instead of {n}")
    return out


def header(version: int = 2, alignment: int = 0) -> bytes:
    return MAGIC + struct.pack(">Q", version) + (struct.pack(">Q", alignment) if version >= 2 else b"")


def parse_header(data: bytes) -> tuple[int, int, int]:
    """(version, alignment, length) of a file header."""
    if not data.startswith(MAGIC):
        raise Corruption("not a log file")
    r = Reader(data, len(MAGIC))
    version = r.number(">Q")
    if version not in (1, 2):
        raise Corruption(f"unknown version {version}")
    return version, r.number(">Q") if version == 2 else 0, r.at


def encode_items(items: list[Item]) -> tuple[bytes, bytes]:
    """(payloads, items with their count)."""
    body, payloads = bytearray(var_u64(len(items))), bytearray()
    for i in items:
        body += var_u64(i.region_id)
        if i.kind == "ENTRIES":
            body += bytes([ENTRIES]) + var_u64(len(i.payloads)) + (var_u64(i.first_index) if i.payloads else b"")
            for p in i.payloads:
                payloads += p
                body += var_u64(len(payloads))  # where the entry ends
        elif i.kind == "CLEAN":
            body += bytes([COMMAND, CLEAN])
        elif i.kind == "COMPACT":
            body += bytes([COMMAND, COMPACT]) + var_u64(i.first_index)
        else:
            body += bytes([KV, PUT if i.kind == "PUT" else DEL]) + var_u64(len(i.key)) + i.key
            if i.kind == "PUT":
                body += var_u64(len(i.value)) + i.value
    return bytes(payloads), bytes(body)


def encode_batch(batch: LogBatch, file_seq: int, version: int = 2, threshold: int = 8 << 10) -> bytes:
    """A batch as it lies in file ``file_seq``; payloads of at least ``threshold`` bytes (0: never) are compressed."""
    payloads, body = encode_items(batch.items)
    kind, block = PLAIN, b""
    if payloads:
        if threshold and len(payloads) >= threshold:
            kind, payloads = LZ4, compress(payloads)
        block = payloads + struct.pack("<I", crc32(payloads))
    sign = file_seq & 0xFFFFFFFF if version >= 2 else 0
    footer = body + struct.pack("<I", crc32(body) ^ sign)
    return struct.pack(">QQ", (16 + len(block) + len(footer)) << 8 | kind, 16 + len(block)) + block + footer


def decode_batch(data: bytes, at: int, file_seq: int, version: int) -> tuple[int, int, int, list[Item], list[list[int]], bytes]:
    """(end, compression, place of the footer, items, lengths of their entries, raw entries block) of the batch at ``at``."""
    if len(data) - at < 16:
        raise Corruption("batch header is cut short")
    word, footer_at = struct.unpack_from(">QQ", data, at)
    size, kind = word >> 8, word & 0xFF
    if kind not in (PLAIN, LZ4):
        raise Corruption(f"unknown compression {kind}")
    if footer_at < 16 or footer_at > size or at + size > len(data):
        raise Corruption("batch reaches beyond the file")
    body, stored = data[at + footer_at : at + size - 4], struct.unpack_from("<I", data, at + size - 4)[0] if size >= footer_at + 4 else None
    if stored is None or crc32(body) != stored ^ (file_seq & 0xFFFFFFFF if version >= 2 else 0):
        raise Corruption("checksum of the items doesn't match")
    r, items, lengths, done = Reader(body), [], [], 0
    for _ in range(r.var_u64()):
        region, tag = r.var_u64(), r.byte()
        if tag == ENTRIES:
            n = r.var_u64()
            first = r.var_u64() if n else 0
            sizes = []
            for _ in range(n):
                end = r.var_u64()
                if end < done:
                    raise Corruption("entry offsets go back")
                sizes.append(end - done)
                done = end
            items.append(Item(region, "ENTRIES", first, [b""] * n))
            lengths.append(sizes)
        elif tag == COMMAND:
            what = r.byte()
            if what not in (CLEAN, COMPACT):
                raise Corruption(f"unknown command {what}")
            items.append(Item(region, "CLEAN") if what == CLEAN else Item(region, "COMPACT", r.var_u64()))
            lengths.append([])
        elif tag == KV:
            op = r.byte()
            if op not in (PUT, DEL):
                raise Corruption(f"unknown key operation {op}")
            key = r.take(r.var_u64())
            items.append(Item(region, "PUT" if op == PUT else "DEL", key=key, value=r.take(r.var_u64()) if op == PUT else None))
            lengths.append([])
        else:
            raise Corruption(f"unknown item {tag}")
    if r.at != r.end:
        raise Corruption("bytes after the last item")
    return at + size, kind, at + footer_at, items, lengths, data[at + 16 : at + footer_at]


def payloads_of(block: bytes, kind: int) -> bytes:
    """The payloads of an entries block, its checksum verified."""
    if not block:
        return b""
    if len(block) < 4 or crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise Corruption("checksum of the entries doesn't match")
    return decompress(block[:-4]) if kind == LZ4 else block[:-4]


def compression_ratio(data: bytes, at: int = 0) -> float:
    """Stored over raw bytes of the entries block of an encoded batch; 1 where nothing is compressed."""
    word, footer_at = struct.unpack_from(">QQ", data, at)
    if word & 0xFF != LZ4 or footer_at <= 16:
        return 1.0
    return (footer_at - 20) / max(1, struct.unpack_from("<I", data, at + 16)[0])


@dataclass
class Batch:
    at: int
    kind: int
    items: list[Item]
    lengths: list[list[int]]
    block: bytes


def read_batches(data: bytes, seq: int) -> Iterator[Batch]:
    """The batches of a file in turn; raises at the first that can't be decoded."""
    version, alignment, at = parse_header(data)
    at = round_up(at, alignment) if alignment else at
    while at < len(data):
        if zero_padded(data[at : at + 16]):  # padding up to the next aligned place, or the end
            nxt = round_up(at + 1, alignment) if alignment else len(data)
            if zero_padded(data[at:nxt]):
                at = nxt
                continue
        end, kind, _, items, lengths, block = decode_batch(data, at, seq, version)
        yield Batch(at, kind, items, lengths, block)
        at = end


def rows_of(b: Batch, queue: int, seq: int, raw: bytes | None) -> Iterator[tuple]:
    spot = 0
    for no, (i, sizes) in enumerate(zip(b.items, b.lengths, strict=True)):
        own = None
        if raw is not None and i.kind == "ENTRIES":
            own = []
            for n in sizes:
                own.append(raw[spot : spot + n])
                spot += n
        last = i.first_index + len(sizes) - 1 if i.kind == "ENTRIES" else None
        yield queue, seq, b.at, no, order_key(queue, seq, b.at, no), i.region_id, i.kind, i.first_index, last, i.key, i.value, sizes or None, own, b.kind, None


def read_file(path: str, queue: int, seq: int, mode: str, newest: bool, payloads: bool) -> Iterator[tuple]:
    """Rows of a file.

    'dump' gives a row with ``error`` for a fault and goes on with the next file. Recovery: a batch or header that can't
    be decoded ends the file in tolerate-any mode, and in tolerate-tail mode if the file is its queue's newest; else it
    raises. The last batch of any file that can be decoded is dropped if its entries are broken, in every mode but
    absolute. Entries before that are only looked at where payloads are asked for; there a fault raises, but in
    tolerate-any mode the payloads are null.
    """
    fs, inside = open_fs(path)
    with fs.open_input_file(inside) as f:
        data = f.read()
    any_, tail = RecoveryMode.TOLERATE_ANY.value, RecoveryMode.TOLERATE_TAIL.value
    error = lambda at, e: (queue, seq, at, *[None] * 11, f"{type(e).__name__}: {e}")
    batches, held = read_batches(data, seq), None
    while True:
        following = fault = None
        try:
            following = next(batches, None)
        except (LogError, CodecFailure) as e:
            fault = e
        if held is not None:
            raw = None
            try:
                if payloads or (following is None and mode != DUMP):
                    raw = payloads_of(held.block, held.kind)
            except (LogError, CodecFailure) as e:
                if mode == DUMP:
                    yield error(held.at, e)
                    return
                if following is None and mode in (any_, tail):
                    return
                if mode != any_:
                    raise Corruption(f"{path}: {e}") from e
            yield from rows_of(held, queue, seq, raw if payloads else None)
        if following is None:
            break
        held = following
    if fault is not None:
        if mode == DUMP:
            yield error(held.at if held else 0, fault)
        elif mode != any_ and not (mode == tail and newest):
            raise Corruption(f"{path}: {fault}") from fault


@dataclass
class FilesPartition(InputPartition):
    """Files that one task reads, in their order: (queue, file number, path, whether it is its queue's newest)."""

    files: list[tuple[int, int, str, bool]]


def arrow_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    key, value, payloads = (schema.get_field_index(c) for c in ("key", "value", "payloads"))
    for row in rows:
        held.append(row)
        n += len(row[key] or b"") + len(row[value] or b"") + sum(map(len, row[payloads] or ()))
        if len(held) >= BATCH_ROWS or n >= BATCH_BYTES:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


class RawLogReader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema):
        self.schema = schema
        self.mode = options.get("mode", DUMP)
        if self.mode not in (DUMP, *(m.value for m in RecoveryMode)):
            raise InvalidArgument(f"unknown mode {self.mode!r}")
        self.payloads = options.get("payloads", "true").lower() == "true"
        path = options["path"]
        fs, inside = open_fs(path)
        if fs.get_file_info(inside).is_file:
            p = parse_file_name(path.rsplit("/", 1)[-1])
            if not p:
                raise InvalidArgument(f"not a log file: {path}")
            self.files = [(*p, path, 0)]
        else:
            found = scan_sizes(path, *filter(None, [options.get("spill")]))
            self.files = found if self.mode == DUMP else newest_without_gap(found)
        # of all files, whatever filters are pushed: a filter must not change what counts as a log's tail
        self.newest = {q: s for q, s, *_ in self.files}  # each queue's files are in order

    def __getstate__(self) -> dict:
        """Every task gets the reader, and its own files by its partition: the list of all files stays in the driver."""
        return self.__dict__ | {"files": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on queue and file_seq chooses files; everything else is Spark's.

        Recovery reads all files, so that a fault is found whatever the query asks for.
        """
        for f in filters:
            if self.mode == DUMP and isinstance(f, EqualTo) and f.attribute in (("queue",), ("file_seq",)):
                self.files = [x for x in self.files if x[f.attribute == ("file_seq",)] == f.value]
            yield f

    def partitions(self) -> list[InputPartition]:
        costs = [size + OPEN_BYTES for *_, size in self.files]
        room = min(PART_BYTES, sum(costs) / LEAST_PARTS)
        parts, held = [], 0
        for (q, seq, path, _), cost in zip(self.files, costs, strict=True):
            if not parts or held + cost > room:
                parts.append(FilesPartition([]))
                held = 0
            parts[-1].files.append((q, seq, path, self.newest[q] == seq))
            held += cost
        return parts

    def read(self, partition: FilesPartition | None) -> Iterator[pa.RecordBatch]:
        """Without any file Spark asks for one partition None."""
        files = partition.files if partition else []
        rows = (row for q, seq, path, newest in files for row in read_file(path, q, seq, self.mode, newest, self.payloads))
        return arrow_batches(rows, self.schema)


class RawLogSource(DataSource):
    """``spark.read.format("raw_log").option("path", dir)``; options mode ('dump' or a recovery mode), spill (a second folder) and payloads."""

    @classmethod
    def name(cls) -> str:
        return "raw_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RawLogReader(dict(self.options), to_arrow_schema(schema))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawLogSource)


class RawLogWriter:
    """Appends batches to the files of one queue in a folder, rotating before a write once a file has its target size.

    New files go to the first of ``path`` and ``spill`` that has room for one. ``compression_ratio`` is that of the last
    batch written.
    """

    def __init__(self, path: str, queue: int = 0, target_file_size: int = 128 << 20, version: int = 2, threshold: int = 8 << 10, spill: str | None = None):
        self.paths = [path, *filter(None, [spill])]
        self.queue, self.target, self.version, self.threshold = queue, target_file_size, version, threshold
        self.compression_ratio = 1.0
        for p in self.paths:
            os.makedirs(p, exist_ok=True)
        have = [f for f in scan_dir(*self.paths) if f[0] == queue]
        self.seq = have[-1][1] if have else 1
        self.file = have[-1][2] if have else ""
        if not have:
            self._create()

    def _create(self) -> None:
        room = [p for p in self.paths if shutil.disk_usage(p).free >= self.target]
        self.file = os.path.join((room or self.paths)[0], file_name(self.queue, self.seq))
        with open(self.file, "xb") as f:
            f.write(header(self.version))

    def rotate(self) -> None:
        self.seq += 1
        self._create()

    def write(self, batch: LogBatch) -> int:
        """Bytes written; an empty batch writes nothing."""
        if batch.is_empty():
            return 0
        if os.path.getsize(self.file) >= self.target:
            self.rotate()
        data = encode_batch(batch, self.seq, self.version, self.threshold)
        self.compression_ratio = compression_ratio(data)
        with open(self.file, "ab") as f:
            f.write(data)
        return len(data)


def write_table(items: DataFrame, folder: str, threshold: int = 8 << 10, version: int = 2) -> DataFrame:
    """Write a log table (queue, file_seq, lsn, batch_id, region_id, kind, first_index, key, value, payloads) as raw files.

    Each file is one task's work, written aside and renamed; a task writes its files one after the other and holds one batch.
    Gives queue, file_seq, n_bytes, raw_bytes, stored_bytes (of entries) of each file; the files are there when that is read.
    """
    fields = ["queue", "file_seq", "lsn", "batch_id", "region_id", "kind", "first_index", "key", "value", "payloads"]

    def write(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for t in tables for r in zip(*(c.to_pylist() for c in t.columns), strict=True))
        fs, inside = open_fs(folder)
        fs.create_dir(inside, recursive=True)
        for (queue, seq), own in itertools.groupby(rows, key=lambda r: r[:2]):
            aside = f"{inside}/.{file_name(queue, seq)}.{uuid.uuid4().hex}"
            with fs.open_output_stream(aside) as f:
                head = header(version)
                f.write(head)
                size, raw, stored = len(head), 0, 0
                for _, group in itertools.groupby(own, key=lambda r: r[3]):
                    batch = LogBatch()
                    batch.items = [Item(region, kind, first, payloads or [], key, value) for *_, region, kind, first, key, value, payloads in group]
                    data = encode_batch(batch, seq, version, threshold)
                    n = sum(len(p) for i in batch.items for p in i.payloads)
                    size, raw, stored = size + len(data), raw + n, stored + round(n * compression_ratio(data))
                    f.write(data)
            fs.move(aside, f"{inside}/{file_name(queue, seq)}")
            yield pa.RecordBatch.from_pydict({"queue": pa.array([queue], pa.int8()), "file_seq": [seq], "n_bytes": [size], "raw_bytes": [raw], "stored_bytes": [stored]})

    fs, inside = open_fs(folder)
    fs.create_dir(inside, recursive=True)  # a log without operations is a folder without files
    dealt = items.select(*fields).repartition("queue", "file_seq").sortWithinPartitions("queue", "file_seq", "lsn")
    return dealt.mapInArrow(write, "queue tinyint, file_seq long, n_bytes long, raw_bytes long, stored_bytes long")
