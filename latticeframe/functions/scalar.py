"""Scalar expressions: ids, checksums, hex, intervals and block sizes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQuery

BLOCK = 4096


def node_id(key: Column) -> Column:
    """SHA-256 of a key, 32 bytes.  (The reference derives ids with BLAKE3, which Spark doesn't have.)"""
    return F.unhex(F.sha2(key.cast("binary"), 256))


def node_id_of(key: bytes | str) -> bytes:
    return hashlib.sha256(key.encode() if isinstance(key, str) else key).digest()


def to_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def from_hex(text: str) -> bytes:
    """An id from exactly 64 hexadecimal digits."""
    if len(text) != 64 or any(c not in "0123456789abcdefABCDEF" for c in text):
        raise InvalidQuery("a node id has 64 hexadecimal digits")
    return bytes.fromhex(text)


def rounded_to_block(n: Column) -> Column:
    """The next multiple of 4096."""
    return (F.ceil(n / F.lit(BLOCK)) * BLOCK).cast("bigint")


def node_bytes(dimension: Column, points: Column, edges: Column) -> Column:
    """Logical size of a node: header, codes, points and edges."""
    return (F.lit(64) + dimension + points * 16 + edges * 40).cast("bigint")


def cache_bytes(layers: Column, blocks: Column, heads: Column, head_size: Column, block_size: Column, element: Column) -> Column:
    """Bytes of keys and values of a cache."""
    return (F.lit(2).cast("bigint") * layers * blocks * heads * head_size * block_size * element).cast("bigint")
