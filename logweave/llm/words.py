"""Vectorised word splitting and hashing over UTF-8 bytes.

A word is a run of bytes outside ASCII white space; that equals the contracts' ``[^\\x20\\x09-\\x0D]+``
because UTF-8 never uses those bytes inside a longer character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import SPACE

U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * U(0xA24BAED4963EE407) + b * U(0x9FB21C651E98DF25) + U(1))


def blocks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is a range of its own."""
    at = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield at, i
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(joined lower-case bytes, word starts, word ends, index of each text's first word + total)."""
    joined = b"\n".join(texts).lower() + b"\n"
    b = np.frombuffer(joined, np.uint8)
    space = _IS_SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return joined, starts, ends, np.searchsorted(starts, at)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of the texts in turn, index of each text's first word + total)."""
    joined, starts, ends, first = spans(texts)
    if not len(starts):
        return np.zeros(0, U), first
    b = np.frombuffer(joined, np.uint8)
    total = np.zeros(len(b) + 1, U)
    np.cumsum(_BYTE[b] * _power(_P, len(b), "p"), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_PINV, len(b), "inverse")[starts]
    return mix(h), first


def shingle_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words starting at each word, whether the run stays in its text)."""
    out = h.copy()
    for k in range(1, n):
        out[: len(h) - k] = join_hash(out[: len(h) - k], h[k:])
    inside = np.zeros(len(h), bool)
    ends = np.repeat(first[1:], np.diff(first))
    inside[:] = np.arange(len(h)) + n <= ends
    return out, inside
