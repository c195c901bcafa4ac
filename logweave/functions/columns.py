"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reserved key, and the key (with its prefix) of atomic-group markers.
INTERNAL_KEY = b"__\x01"
#: Fixed value: the largest index that a signed column holds; repair compacts to it.
MAX_INDEX = (1 << 63) - 1


def is_internal(key: Column) -> Column:
    """Whether a key is reserved; false for a null key."""
    return F.coalesce(key == F.lit(INTERNAL_KEY), F.lit(False))


def is_entries(kind: Column) -> Column:
    return kind == "ENTRIES"


def checksum(body: Column, file_seq: Column, signed: bool = True) -> Column:
    """CRC-32 of a batch body, signed with the low half of the file number."""
    crc = F.crc32(body)
    return crc.bitwiseXOR(file_seq.bitwiseAND(F.lit(0xFFFFFFFF))) if signed else crc


def aligned_up(x: Column, to: int) -> Column:
    return F.ceil(x / F.lit(to)).cast("long") * F.lit(to)


def aligned_down(x: Column, to: int) -> Column:
    return F.floor(x / F.lit(to)).cast("long") * F.lit(to)


def bucket(x: Column, start: float, factor: float, count: int) -> Column:
    """Number of the exponential histogram bucket (upper bounds start * factor**i, inclusive); ``count`` is overflow."""
    bounds = [start * factor**i for i in range(count)]
    out = F.lit(count)
    for i in range(count - 1, -1, -1):
        out = F.when(x <= F.lit(bounds[i]), F.lit(i)).otherwise(out)
    return out
