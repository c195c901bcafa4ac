"""Typed errors."""

from __future__ import annotations


class LogError(Exception):
    """Base of all errors of this engine."""


class InvalidArgument(LogError):
    pass


class Corruption(LogError):
    pass


class IoFailure(LogError):
    pass


class CodecFailure(LogError):
    pass


class DecodeFailure(LogError):
    """A payload can't be parsed as the message asked for."""


class TryAgain(LogError):
    pass


class EntryCompacted(LogError):
    pass


class EntryNotFound(LogError):
    pass


class BatchFull(LogError):
    pass


class OtherFailure(LogError):
    pass


#: Status texts of batch reads, and the errors that single reads raise for them.
STATUS = {"Compacted": EntryCompacted, "NotFound": EntryNotFound}
