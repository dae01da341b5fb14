"""Versioned storage: a commit log over Parquet files, branches, sessions and chunked binary caches."""

from .branch import Branch, Engine, MergeOutcome, Transaction
from .kvcache import KvCacheSpec, KvCacheStore
from .session import Session, SessionManager

__all__ = ["Branch", "Engine", "KvCacheSpec", "KvCacheStore", "MergeOutcome", "Session", "SessionManager", "Transaction"]
