"""Log batches: the atomic unit of writes, built in the driver and written as rows or raw bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import BatchFull, InvalidArgument
from ..functions.columns import INTERNAL_KEY

#: Fixed value: the most payload bytes of a batch.
MAX_BYTES = (1 << 31) - 1


@dataclass
class Item:
    region_id: int
    kind: str  # ENTRIES, COMPACT, CLEAN, PUT, DEL
    first_index: int | None = None
    payloads: list[bytes] = field(default_factory=list)
    key: bytes | None = None
    value: bytes | None = None

    @property
    def last_index(self) -> int | None:
        return self.first_index + len(self.payloads) - 1 if self.kind == "ENTRIES" else None


class LogBatch:
    def __init__(self) -> None:
        self.items: list[Item] = []
        self.payload_bytes = 0

    def add_entries(self, region_id: int, first_index: int, payloads: list[bytes]) -> None:
        """A run of entries with consecutive indexes; refused as a whole when the batch would grow over its limit."""
        size = sum(map(len, payloads))
        if self.payload_bytes + size > MAX_BYTES:
            raise BatchFull(f"{self.payload_bytes + size} bytes")
        if payloads:
            self.payload_bytes += size
            self.items.append(Item(region_id, "ENTRIES", first_index, list(payloads)))

    def compact(self, region_id: int, index: int) -> None:
        self.items.append(Item(region_id, "COMPACT", index))

    def clean(self, region_id: int) -> None:
        self.items.append(Item(region_id, "CLEAN"))

    def put(self, region_id: int, key: bytes, value: bytes) -> None:
        if key == INTERNAL_KEY:
            raise InvalidArgument("the key is reserved")
        self.items.append(Item(region_id, "PUT", key=key, value=value))

    def put_message(self, region_id: int, key: bytes, message) -> None:
        """A message with a SerializeToString method, as protobuf's have."""
        self.put(region_id, key, message.SerializeToString())

    def delete(self, region_id: int, key: bytes) -> None:
        if key == INTERNAL_KEY:
            raise InvalidArgument("the key is reserved")
        self.items.append(Item(region_id, "DEL", key=key))

    def merge(self, other: LogBatch) -> None:
        """Append the other batch's items; the other is empty afterwards."""
        if self.payload_bytes + other.payload_bytes > MAX_BYTES:
            raise BatchFull(f"{self.payload_bytes + other.payload_bytes} bytes")
        self.items += other.items
        self.payload_bytes += other.payload_bytes
        other.items, other.payload_bytes = [], 0

    def is_empty(self) -> bool:
        return not self.items

    def approximate_size(self) -> int:
        """Bytes of payloads and an upper estimate of the items around them."""
        if not self.items:
            return 0
        size = 16 + self.payload_bytes + 4 + 8 + 4
        for i in self.items:
            size += 9 + {"ENTRIES": 16 + 8 * len(i.payloads), "COMPACT": 9, "CLEAN": 1}.get(i.kind, 17 + len(i.key or b"") + len(i.value or b""))
        return size

    def rows(self, batch_id: int, queue: int, file_seq: int, lsn: int) -> list[tuple]:
        """Rows of the log table, in order; ``lsn`` is that of the first."""
        return [(queue, file_seq, lsn + n, batch_id, n, i.region_id, i.kind, i.first_index, i.last_index, i.key, i.value, i.payloads or None) for n, i in enumerate(self.items)]


#: Columns of the log table.
SCHEMA = "queue tinyint, file_seq long, lsn long, batch_id long, item_no int, region_id long, kind string, first_index long, last_index long, key binary, value binary, payloads array<binary>"
