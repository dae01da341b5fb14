"""Line dedup with compressed keep bitmaps (operator 5, DataFrame functions only).

A line's key is the line stripped of ASCII white space at both ends, with A-Z lower-cased; keys of at least
``min_chars`` code points that occur in two or more documents stay only in the smallest doc_id that holds them.

Keys travel as 128-bit hashes (two seeds).  Hashes that hold more than their share of all lines are found first, by a
count with partial sums that also gives their smallest document: there are at most ``4 * partitions`` of them, so they
are decided by a broadcast join.  All other hashes are range-partitioned, sorted by document and position within the
partition, and a running first value streams each hash's first document past its other lines.  Only the dropped
positions leave that stage; a document's keep bitmap is their complement, run-length encoded: the lengths of runs of
kept and dropped lines in turn, kept ones first, as 32-bit numbers, so a document that drops nothing has four bytes.

Edge cases: a null or empty text is one empty line; a null doc_id sorts before all others; rows that repeat a
doc_id count as one document but keep their own lines; of equal lines in one document all stay or all go; very long texts
and lines are hashed whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored, tasks

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line):
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _occurrences(documents: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, row (tells repeated doc_ids apart), pos of every line whose key is long enough."""
    lines = documents.select("doc_id", "row", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(41), F.col("key")).alias("h2"), "doc_id", "row", "pos")


def dropped_lines(documents: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, row, pos of the lines to drop; ``documents`` has doc_id, row and text."""
    spark = documents.sparkSession
    n = tasks(spark)
    lines, _ = stored(_occurrences(documents, min_chars), "lines")  # hashes and positions; read by each step below
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max(F.col("doc_id").isNull()).alias("null_first"))
    total = lines.count()
    hot, _ = stored(counts.where(F.col("n") > max(1000, total // (4 * n))).select("h1", "h2", F.col("first_doc"), "null_first"), "hot-lines")
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    by_hot = marked.where("doc_id > first_doc OR (null_first AND doc_id IS NOT NULL)").select("doc_id", "row", "pos")
    rest = marked.where("null_first IS NULL").drop("first_doc", "null_first")
    dealt = rest.repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", F.col("doc_id").asc_nulls_first(), "pos")
    stream = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_first(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("first", F.first(F.struct("doc_id")).over(stream))
    by_stream = seen.where(~F.col("first.doc_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "row", "pos")
    return by_hot.unionAll(by_stream)


def keep_bitmap(dropped, n_lines):
    """The run-length encoded keep bitmap, from a document's sorted dropped positions and its number of lines."""
    first = F.filter(F.transform(dropped, lambda p, i: F.struct(p.alias("p"), i.alias("i"), F.when(i > 0, F.get(dropped, i - 1)).otherwise(-2).alias("before"))), lambda x: x["p"] != x["before"] + 1)
    # a run of dropped lines begins at ``p``, its place in the list is ``i``; the next run's place tells how long it is
    starts, places = F.transform(first, lambda x: x["p"]), F.transform(first, lambda x: x["i"])
    lengths = F.zip_with(places, F.slice(F.concat(places, F.array(F.size(dropped))), F.lit(2), F.size(places)), lambda a, b: b - a)
    ends = F.concat(F.array(F.lit(0)), F.zip_with(starts, lengths, lambda s, n: s + n))
    runs = F.zip_with(F.zip_with(F.concat(starts, F.array(n_lines)), ends, lambda s, e: s - e), lengths, lambda kept, gone: F.array(kept, gone))
    words = F.filter(F.flatten(runs), lambda n: n.isNotNull())
    return F.unhex(F.array_join(F.transform(words, lambda n: F.lpad(F.hex(n), 8, "0")), ""))


def keep_flags(bitmap):
    """A bitmap as one boolean a line."""
    words = F.transform(F.split(F.hex(bitmap), r"(?<=\G.{8})"), lambda w: F.conv(w, 16, 10).cast("int"))
    return F.flatten(F.transform(F.filter(words, lambda n: n.isNotNull()), lambda n, i: F.array_repeat(i % 2 == 0, n)))


def kept_text(lines, bitmap):
    """The kept lines, joined."""
    return F.array_join(F.zip_with(lines, keep_flags(bitmap), lambda line, keep: F.when(keep, line)), "\n")


def dedup_lines(documents: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row a document: doc_id, text, n_lines, n_dropped, keep (the bitmap)."""
    rows = documents.select(F.col("doc_id"), F.xxhash64("text").alias("row"), "text")
    gone = dropped_lines(rows, min_chars).groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    gone = gone.select(F.col("doc_id").alias("gone_doc"), F.col("row").alias("gone_row"), "dropped")
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_doc")) & (F.col("row") == F.col("gone_row")), "left")
    none = F.array().cast("array<int>")
    n = F.size(lines_of(F.col("text")))
    out = both.select("doc_id", "text", n.alias("n_lines"), F.coalesce("dropped", none).alias("dropped"))
    return out.select("doc_id", "text", "n_lines", F.size("dropped").alias("n_dropped"), keep_bitmap(F.col("dropped"), F.col("n_lines")).alias("keep"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kept = F.when(F.col("n_dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(kept_text(lines_of(F.col("text")), F.col("keep")))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, i AS pos, l[i] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE coalesce(doc_id > first_doc, false))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(doc_id > first_doc, false)), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id
"""
