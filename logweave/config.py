"""Engine configuration: readable sizes, defaults, validation and derived capacities."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, fields, replace
from enum import Enum

from .errors import InvalidArgument

_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]


def parse_size(text: str | int) -> int:
    """Bytes of '16KB', '1.5 GiB' or a bare number; units are binary."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*(?:([KMGTP])(?:i?B)?|B)?\s*", text, re.ASCII)
    if not m:
        raise InvalidArgument(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** " KMGTP".index(m[2] or " "))


def format_size(n: int) -> str:
    """The largest unit that divides ``n``; zero is '0KiB'."""
    if not n:
        return "0KiB"
    power = 0
    while power < 5 and n % 1024 == 0:
        n, power = n // 1024, power + 1
    return f"{n}{_UNITS[power]}"


def as_mb(n: int) -> int:
    return n >> 20


class RecoveryMode(Enum):
    ABSOLUTE = "absolute-consistency"
    TOLERATE_TAIL = "tolerate-tail-corruption"
    TOLERATE_ANY = "tolerate-any-corruption"


@dataclass(frozen=True)
class EngineConfig:
    """Field names are those of the kebab-case configuration file."""

    # fixed values: defaults and least values of the configuration
    dir: str = ""
    spill_dir: str | None = None
    recovery_mode: RecoveryMode = RecoveryMode.TOLERATE_TAIL
    recovery_read_block_size: int = 16 << 10
    recovery_threads: int = 4
    batch_compression_threshold: int = 8 << 10
    compression_level: int | None = None
    bytes_per_sync: int | None = None
    format_version: int = 2
    target_file_size: int = 128 << 20
    purge_threshold: int = 10 << 30
    purge_rewrite_threshold: int | None = None
    purge_rewrite_garbage_ratio: float = 0.6
    memory_limit: int | None = None
    enable_log_recycle: bool = True
    prefill_for_recycle: bool = False
    prefill_limit: int | None = None

    @classmethod
    def from_dict(cls, values: dict) -> EngineConfig:
        """From a parsed configuration file; sizes may be texts."""
        known = {f.name: f for f in fields(cls)}
        out = {}
        for k, v in values.items():
            name = k.replace("-", "_")
            if name not in known:
                raise InvalidArgument(f"unknown setting {k}")
            if name == "recovery_mode" and not isinstance(v, RecoveryMode):
                v = RecoveryMode(v)
            elif isinstance(v, str) and "int" in str(known[name].type):
                v = parse_size(v)
            out[name] = v
        return cls(**out)

    def sanitize(self) -> EngineConfig:
        """A valid configuration, or InvalidArgument; soft faults are put right with a warning."""
        out = self
        if out.purge_threshold < out.target_file_size:
            raise InvalidArgument("purge-threshold < target-file-size")
        if out.enable_log_recycle and out.format_version < 2:
            raise InvalidArgument("log recycling needs format version 2")
        if out.prefill_for_recycle and not out.enable_log_recycle:
            raise InvalidArgument("prefill needs log recycling")
        if out.purge_rewrite_threshold is None:
            out = replace(out, purge_rewrite_threshold=max(out.purge_threshold // 10, out.target_file_size))
        if out.bytes_per_sync is not None:
            warnings.warn("bytes-per-sync is deprecated", stacklevel=2)
        if out.recovery_read_block_size < 512:
            warnings.warn("recovery-read-block-size raised to 512", stacklevel=2)
            out = replace(out, recovery_read_block_size=512)
        if out.recovery_threads < 1:
            warnings.warn("recovery-threads raised to 1", stacklevel=2)
            out = replace(out, recovery_threads=1)
        if not out.prefill_for_recycle and out.prefill_limit is not None:
            warnings.warn("prefill-limit is ignored without prefill", stacklevel=2)
            out = replace(out, prefill_limit=None)
        if out.prefill_for_recycle and out.prefill_limit is None:
            out = replace(out, prefill_limit=out.purge_threshold)
        return out

    def _capacity(self, n_bytes: int) -> int:
        """Files of the target size in ``n_bytes``, and half as many again."""
        return min(n_bytes // self.target_file_size * 3 // 2, (1 << 32) - 1) if n_bytes >= self.target_file_size else 0

    @property
    def recycle_capacity(self) -> int:
        return self._capacity(self.purge_threshold) if self.enable_log_recycle and self.format_version >= 2 else 0

    @property
    def prefill_capacity(self) -> int:
        return self._capacity(self.prefill_limit or 0) if self.recycle_capacity and self.prefill_for_recycle else 0
