"""What can go wrong, as exceptions a caller can tell apart."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors this library raises on purpose."""


class DimensionMismatch(EngineError):
    pass


class InvalidVector(EngineError):
    pass


class InvalidQuery(EngineError):
    pass


class InvalidInterval(EngineError):
    pass


class DuplicateNode(EngineError):
    pass


class UnknownNode(EngineError):
    pass


class UnknownBranch(EngineError):
    pass


class StaleTransaction(EngineError):
    pass


class MergeConflict(EngineError):
    def __init__(self, ranges: int):
        super().__init__(f"{ranges} conflicting ranges")
        self.ranges = ranges


class InjectedFault(EngineError):
    pass


class Invariant(EngineError):
    pass


class DatabaseLocked(EngineError):
    pass


class LogPoisoned(EngineError):
    pass


class CorruptLog(EngineError):
    pass


class CorruptData(EngineError):
    pass


class KvCacheError(EngineError):
    pass


class SessionError(EngineError):
    pass
