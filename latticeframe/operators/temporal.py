"""Bitemporal records: (key, value, valid_from, valid_to, asserted_at), intervals half-open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

RECORD = ("key", "value", "valid_from", "valid_to", "asserted_at")
RANGE = ("key", "valid_from", "valid_to")


def valid_at(records: DataFrame, at) -> DataFrame:
    at = at if isinstance(at, Column) else F.lit(at)
    return records.where((F.col("valid_from") <= at) & (at < F.col("valid_to")))


def _latest() -> Column:
    """Orders candidates: latest assertion first, then the smallest interval start and end."""
    return F.struct((-F.col("asserted_at")).alias("o"), F.col("valid_from").alias("f"), F.col("valid_to").alias("t"))


def get_as_of(records: DataFrame, key, at: int, known_by: int | None = None) -> DataFrame:
    """The record of a key that is valid at a time, as known at an epoch: at most one row; filters reach the scan."""
    rows = valid_at(records.where(F.col("key") == key), at)
    if known_by is not None:
        rows = rows.where(F.col("asserted_at") <= known_by)
    return rows.select(*RECORD).orderBy(F.desc("asserted_at"), "valid_from", "valid_to").limit(1)


def _level(start: Column, end: Column) -> Column:
    """The power of two above an interval's length, as its number of bits: at that width an interval lies in two buckets at most."""
    size = end - start
    return F.when(size < 0, 63).otherwise(F.length(F.bin(size))).cast("int")


def _bucket(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level)


def _buckets(start: Column, end: Column, level: Column) -> Column:
    return F.array_distinct(F.array(_bucket(start, level), _bucket(end - 1, level)))


def _levels(rows: DataFrame, start: str, end: str) -> list[int]:
    return sorted(r[0] for r in rows.select(_level(F.col(start), F.col(end))).where(F.col(start) < F.col(end)).distinct().collect())  # 63 at most


def as_of_join(probes: DataFrame, records: DataFrame) -> DataFrame:
    """For each probe (probe_id, key, at, known_by) the record then valid and known; probes without one are left out.

    Records of one interval are one range.  A range lies in at most two buckets as wide as its interval's power of two, a
    probe in one of each width that occurs: one equi-join on key, width and bucket, so a probe meets the ranges of its time,
    however many records share them.  Within a range records and probes are sorted by epoch together and each probe takes
    the record before it, in one pass; what ranges answer meets in a minimum with partial sums.
    """
    facts = records.where("valid_from < valid_to AND asserted_at IS NOT NULL")
    ranges = facts.select(*RANGE).distinct().withColumn("level", _level(F.col("valid_from"), F.col("valid_to")))
    ranges = ranges.withColumn("bucket", F.explode(_buckets(F.col("valid_from"), F.col("valid_to"), F.col("level"))))
    widths = _levels(records, "valid_from", "valid_to")
    asks = probes.where("known_by IS NOT NULL").withColumn("level", F.explode(F.array(*(F.lit(x) for x in widths)).cast("array<int>")))
    asks = asks.withColumn("bucket", _bucket(F.col("at"), F.col("level")))
    met = asks.join(ranges, ["key", "level", "bucket"]).where((F.col("valid_from") <= F.col("at")) & (F.col("at") < F.col("valid_to")))
    none = lambda c: F.lit(None).cast(c.dataType)
    met = met.select(*RANGE, F.col("known_by").alias("epoch"), F.lit(1).alias("side"), "probe_id", none(records.schema["value"]).alias("value"))
    met = met.unionAll(facts.where("key IS NOT NULL").select(*RANGE, "asserted_at", F.lit(0), none(probes.schema["probe_id"]), "value"))
    dealt = met.repartition(*RANGE).sortWithinPartitions(*RANGE, "epoch", "side")
    kinds = {"asserted_at": met.schema["epoch"].dataType}
    out = StructType([StructField(c, kinds[c] if c in kinds else met.schema[c].dataType) for c in ("probe_id", *RECORD)])
    both = dealt.mapInArrow(_records_before, out)
    best = both.groupBy("probe_id", "key").agg(F.min_by(F.struct("value", "valid_from", "valid_to", "asserted_at"), _latest()).alias("r"))
    return best.select("probe_id", "key", "r.value", "r.valid_from", "r.valid_to", "r.asserted_at")


def _records_before(batches):
    """Probes (side 1) with the last record (side 0) before them in their range, over batches sorted by range, epoch and side."""
    held = None  # the last record of the range at hand
    for b in batches:
        if not b.num_rows:
            continue
        rows = b if held is None else pa.concat_batches([held, b])
        at, record = np.arange(rows.num_rows), rows.column("side").to_numpy() == 0
        begins = np.ones(rows.num_rows, bool)
        begins[1:] = np.any([pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False) for x in map(rows.column, RANGE)], axis=0)
        last, begin = np.maximum.accumulate(np.where(record, at, -1)), np.maximum.accumulate(np.where(begins, at, -1))
        asked = np.flatnonzero(~record & (last >= begin))
        probe, found = rows.take(pa.array(asked)), rows.take(pa.array(last[asked]))
        columns = [probe.column("probe_id"), *(found.column(c) for c in ("key", "value", "valid_from", "valid_to", "epoch"))]
        yield pa.record_batch(columns, names=["probe_id", *RECORD])
        held = rows.slice(last[-1], 1) if last[-1] >= begin[-1] else None


def logical_ranges(records: DataFrame) -> DataFrame:
    """The latest value of each (key, valid_from, valid_to)."""
    best = records.groupBy(*RANGE).agg(F.max_by(F.struct("value", "asserted_at"), F.struct("asserted_at", "value")).alias("r"))
    return best.select("key", "r.value", "valid_from", "valid_to", "r.asserted_at")


def changes(branch: DataFrame, base: DataFrame) -> DataFrame:
    """Ranges of ``branch`` whose value isn't the one in ``base``, or that ``base`` doesn't have."""
    b = base.select(*RANGE, F.col("value").alias("base_value"))
    same = [branch[c] == b[c] for c in RANGE] + [branch["value"].eqNullSafe(b["base_value"])]
    return branch.join(b, [*same], "left_anti")


def conflicts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Changed source ranges that overlap a changed target range of the same key with another value; one row each.

    Ranges meet in the buckets of the wider one's width, where each lies in two at most.
    """
    widths = F.array(*(F.lit(x) for x in sorted({*_levels(source, "valid_from", "valid_to"), *_levels(target, "valid_from", "valid_to")}))).cast("array<int>")

    def dealt(rows, own):
        at = rows.withColumn(own, _level(F.col("valid_from"), F.col("valid_to")))
        at = at.withColumn("level", F.explode(F.filter(widths, lambda x: x >= F.col(own))))
        return at.withColumn("bucket", F.explode(_buckets(F.col("valid_from"), F.col("valid_to"), F.col("level"))))

    s = dealt(source, "s_level")
    t = dealt(target, "t_level").select(F.col("key").alias("t_key"), F.col("value").alias("t_value"), F.col("valid_from").alias("t_from"), F.col("valid_to").alias("t_to"), "t_level", F.col("level").alias("t_width"), F.col("bucket").alias("t_bucket"))
    meet = (s["key"] == t["t_key"]) & (s["level"] == t["t_width"]) & (s["bucket"] == t["t_bucket"]) & (s["level"] == F.greatest(s["s_level"], t["t_level"]))
    meet &= (s["valid_from"] < t["t_to"]) & (t["t_from"] < s["valid_to"]) & ~s["value"].eqNullSafe(t["t_value"])
    return s.join(t, meet, "left_semi").select(*source.columns).distinct()


def merged(target: DataFrame, applied: DataFrame, epoch: int) -> DataFrame:
    """The target's records with the applied source ranges asserted at the merge's epoch."""
    return target.select(*RECORD).unionByName(applied.withColumn("asserted_at", F.lit(epoch).cast("bigint")).select(*RECORD))
