"""Number codecs of the raw log format, hashing and alignment, in plain Python."""

from __future__ import annotations

import struct
import zlib

from ..errors import CodecFailure

M64 = (1 << 64) - 1
SIGN = 1 << 63


def crc32(data: bytes) -> int:
    return zlib.crc32(data)


def hash_u64(x: int) -> int:
    """splitmix64's output function."""
    # fixed values: the multipliers and shifts of splitmix64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def unhash_u64(x: int) -> int:
    """The inverse of ``hash_u64``."""
    x ^= x >> 31 ^ x >> 62
    x = x * pow(0x94D049BB133111EB, -1, 1 << 64) & M64
    x ^= x >> 27 ^ x >> 54
    x = x * pow(0xBF58476D1CE4E5B9, -1, 1 << 64) & M64
    return x ^ x >> 30 ^ x >> 60


def round_up(x: int, to: int) -> int:
    return -(-x // to) * to


def round_down(x: int, to: int) -> int:
    return x // to * to


class Reader:
    """A place in a byte string."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise CodecFailure("unexpected end of data")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def var_u64(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out & M64
            shift += 7
            if shift >= 70:
                raise CodecFailure("number of more than ten bytes")

    def var_i64(self) -> int:
        u = self.var_u64()
        return ~(u >> 1) if u & 1 else u >> 1

    def number(self, layout: str) -> int | float:
        """A fixed-width number by its struct layout, such as '<I' or '>Q'."""
        return struct.unpack(layout, self.take(struct.calcsize(layout)))[0]


def var_u64(v: int) -> bytes:
    out = bytearray()
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def var_i64(v: int) -> bytes:
    return var_u64(~(v << 1) & M64 if v < 0 else v << 1)


def number(layout: str, v: float) -> bytes:
    return struct.pack(layout, v)


def _float_bits(v: float) -> int:
    return struct.unpack(">Q", struct.pack(">d", v))[0]


def ordered_u64(v: int, descending: bool = False) -> bytes:
    """Eight bytes that compare as the numbers do."""
    return struct.pack(">Q", ~v & M64 if descending else v)


def from_ordered_u64(b: bytes, descending: bool = False) -> int:
    v = struct.unpack(">Q", b)[0]
    return ~v & M64 if descending else v


def ordered_i64(v: int, descending: bool = False) -> bytes:
    return ordered_u64((v & M64) ^ SIGN, descending)


def from_ordered_i64(b: bytes, descending: bool = False) -> int:
    u = from_ordered_u64(b, descending) ^ SIGN
    return u - (1 << 64) if u & SIGN else u


def ordered_f64(v: float, descending: bool = False) -> bytes:
    bits = _float_bits(v)
    return ordered_u64(~bits & M64 if bits & SIGN else bits | SIGN, descending)


def from_ordered_f64(b: bytes, descending: bool = False) -> float:
    u = from_ordered_u64(b, descending)
    return struct.unpack(">d", struct.pack(">Q", u & ~SIGN if u & SIGN else ~u & M64))[0]
