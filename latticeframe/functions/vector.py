"""Vector expressions: quantisation to signed bytes and scores on quantised codes, as Columns.

All sums over codes are integer sums, so scores don't depend on the order of addition; one double expression follows.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 127


def _f32(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def scale_of(vector: Column) -> Column:
    """Largest magnitude over 127 as a 32-bit float; 1 for a zero vector."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x))).cast("float").cast("double")
    return F.when(top == 0, F.lit(1.0)).otherwise(top / LEVELS).cast("float")


def codes_of(vector: Column, scale: Column) -> Column:
    """Codes round(x / scale), halves away from zero, held within 127."""
    def code(x):  # noqa: E306
        ratio = (x.cast("float").cast("double") / scale.cast("double")).cast("float").cast("double")
        return F.greatest(F.lit(-LEVELS), F.least(F.lit(LEVELS), F.round(ratio).cast("int"))).cast("tinyint")

    return F.transform(vector, code)


def dot_codes(a: Column, b: Column) -> Column:
    """Exact integer inner product of two code arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def square_norm(codes: Column) -> Column:
    return dot_codes(codes, codes)


def cosine(dot: Column, a_norm: Column, b_norm: Column) -> Column:
    """Cosine from a dot product and squared norms; 0 if either vector is zero."""
    return F.when((a_norm == 0) | (b_norm == 0), F.lit(0.0)).otherwise(dot.cast("double") / (F.sqrt(a_norm.cast("double")) * F.sqrt(b_norm.cast("double"))))


def l2_score(a: Column, a_scale: Column, b: Column, b_scale: Column) -> Column:
    """Negative squared distance of the decoded vectors."""
    def part(x, y):  # noqa: E306
        d = x.cast("double") * a_scale.cast("double") - y.cast("double") * b_scale.cast("double")
        return d * d

    return -F.aggregate(F.zip_with(a, b, part), F.lit(0.0), lambda s, x: s + x)


def quantize(vector: list[float]) -> tuple[list[int], float]:
    """The same quantisation for one vector on the driver: codes and scale."""
    values = [_f32(float(x)) for x in vector]
    top = max((abs(x) for x in values), default=0.0)
    scale = _f32(top / LEVELS) if top else 1.0
    codes = []
    for x in values:
        r = _f32(x / scale)
        n = math.floor(abs(r) + 0.5)
        codes.append(max(-LEVELS, min(LEVELS, n if r >= 0 else -n)))
    return codes, scale


def literal_codes(codes: list[int]) -> Column:
    return F.array(*(F.lit(c).cast("tinyint") for c in codes))
