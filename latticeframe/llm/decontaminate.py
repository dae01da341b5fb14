"""Benchmark decontamination by CGK embeddings (operator 6).

A document is contaminated by an item if some stretch of its words is within ``floor((1 - similarity) * words)`` word
edits of the item.  Words are runs of letters and digits, lower-cased.  Items too short for one edit must occur as they are.

1. Items are cut in segments of at most ``LONGEST`` words (an item of up to that many is one).  Of a match's edits some
   segment has no more than its share, so it is enough to find one segment of each match.
2. A window of a segment's size is laid at every word of every document.  A window within the edits has all but its
   share of words from the benchmark's words of that size: windows that have fewer are passed over, which loses nothing.
   The words are looked up in one table of bit sets over sizes, of at most ``2**21`` entries whatever the benchmark.
3. Windows and segments pass ``walks`` CGK random walks (at each step a word is written down, and a random bit of walk,
   step and word says whether the walk goes on to the next word), which turn edit distance into Hamming distance.
   ``tables`` samples of ``places`` steps of each walk are hash keys of walk, table and size.  Windows with a key that
   some segment has (a Bloom filter of at most ``2**26`` bits says so) leave the scan.
4. Keys of windows meet keys of segments in an equi-join; neither side passes the driver.  Each pair of a stretch of a
   document and an item is verified once by an exact edit distance in bit-parallel arithmetic.

One pass over the documents.  The walks' bits come from hashes of CLASSES classes of words.  Recall of pairs at the very
edge of the edits is measured in the tests: .95 and more for items of 5 to 150 words; lighter edits are found more surely.

Edge cases: null or empty texts and items match nothing; repeated items all report; rows that repeat both id and text
report once, rows that share only an id each; equally good matches report the first end; very long texts are verified in
stretches of ``STRETCH`` words and report each item once; null ids are returned as they are; empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textsets as ts
from ._shared import bounded_batches, stored

CLASSES = 4096  # words with equal lowest bits share a walk's random bits
LONGEST = 64  # words of a segment; the sizes fit one word of bits
STEPS = 96  # steps of a walk that are sampled, over a segment of LONGEST words: 3 / 2 a word
STRETCH = 2048  # words of a document that are verified together
SLOTS, FILTER = 1 << 21, 1 << 26  # most entries of the table of words, most bits of the filter of keys


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    return ts.words([t.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts], ts.PUNCTUATION)


def allowed(words: int, similarity: float) -> int:
    """Edits that an item of so many words may be away."""
    return int((1 - similarity) * words + 1e-9)


def segments(words: int) -> list[tuple[int, int]]:
    """(offset, size) of an item's segments, of nearly equal sizes up to LONGEST."""
    n = -(-words // LONGEST)
    return [(k * words // n, (k + 1) * words // n - k * words // n) for k in range(n)]


class Walks:
    """CGK walks and their samples; everything follows from the seed."""

    def __init__(self, walks: int, tables: int, places: int, seed: int = 11):
        self.walks, self.tables, self.places, self.seed = walks, tables, places, seed
        salts = ts.mix(np.arange(seed, seed + 2 * walks, dtype=np.uint64))
        self.bits = ts.mix(np.arange(CLASSES, dtype=np.uint64)[None, :] ^ salts[:, None]).reshape(walks, 2, CLASSES)  # by step, in words of 64
        self.factors = ts.mix(np.arange(90, 90 + places, dtype=np.uint64)) | np.uint64(1)

    def samples(self, size: int) -> np.ndarray:
        """Steps to look at for windows of a size: walks x tables x places."""
        steps = max(1, 3 * size // 2)
        return np.random.default_rng((self.seed, size)).integers(0, steps, (self.walks, self.tables, self.places))

    def paths(self, words: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The places that each walk is at, by step: walks x steps x starts.  ``words`` ends in LONGEST zeros or more."""
        out, last = np.empty((self.walks, STEPS, len(start)), np.int32), len(words) - 1
        classes = (words & np.uint64(CLASSES - 1)).astype(np.int32)
        for at, table in zip(out, self.bits, strict=True):
            bits = [half[classes] for half in table]
            i = start.astype(np.int32)
            for j in range(STEPS):
                at[j] = i
                i = i + (bits[j >> 6][np.minimum(i, last)] >> np.uint64(j & 63) & np.uint64(1)).astype(np.int32)
        return out

    def keys(self, words: np.ndarray, start: np.ndarray, paths: np.ndarray, which: np.ndarray, size: int) -> np.ndarray:
        """Hash keys of the windows of a size at ``start[which]``: (walks * tables) x windows."""
        out = np.empty((self.walks, self.tables, len(which)), np.uint64)
        end, samples = start[which] + size, self.samples(size)
        name = np.uint64(size << 20) + (np.arange(self.walks, dtype=np.uint64)[:, None] << np.uint64(10)) + np.arange(self.tables, dtype=np.uint64)
        for w in range(self.walks):
            at = paths[w][samples[w].ravel()][:, which]
            seen = words[np.minimum(at, len(words) - 1)]
            seen[at >= end] = 0
            key = (seen.reshape(self.tables, self.places, -1) * self.factors[:, None]).sum(1, dtype=np.uint64)
            out[w] = ts.mix(key ^ name[w][:, None])
        return out.reshape(self.walks * self.tables, -1)


def _padded(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts one after another with LONGEST zeros after each, and where each text begins."""
    n = len(at) - 1
    begin = at[:-1] + LONGEST * np.arange(n)
    out = np.zeros(len(w) + LONGEST * n, np.uint64)
    out[np.arange(len(w)) + LONGEST * np.repeat(np.arange(n), np.diff(at))] = np.maximum(w, 1)
    return out, begin


def _items(benchmark: DataFrame, similarity: float) -> DataFrame:
    """item, item_id, n, words (packed hashes) of the items with words; ``item`` tells repeated ids apart."""

    def run(batches):
        for b in batches:
            for begin, texts in ts.text_batches(b.column(1)):
                w, at = _words(texts)
                keep = np.flatnonzero(np.diff(at))
                words = pa.array([np.maximum(w[at[k] : at[k + 1]], 1).tobytes() for k in keep], pa.binary())
                yield pa.record_batch([b.column(0).take(pa.array(begin + keep)), pa.array(np.diff(at)[keep]), words], names=["item_id", "n", "words"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, n long, words binary")
    return rows.withColumn("item", F.monotonically_increasing_id())


def _item_keys(items: DataFrame, walks: Walks) -> tuple[DataFrame, DataFrame]:
    """Keys (key, item, offset, size) of all segments; and slots (slot, sizes) of the benchmark's words as sets of sizes."""

    def keys(batches):
        for b in batches:
            for item, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = np.concatenate((np.frombuffer(packed, np.uint64), np.zeros(LONGEST, np.uint64)))
                parts = segments(len(w) - LONGEST)
                start = np.array([o for o, _ in parts])
                paths = walks.paths(w, start)
                for k, (offset, size) in enumerate(parts):
                    key = walks.keys(w, start, paths, np.array([k]), size)[:, 0].view(np.int64)
                    yield pa.record_batch([pa.array(key), *(pa.array(np.full(len(key), x, np.int64)) for x in (item, offset, size))], names=["key", "item", "offset", "size"])

    def words(batches):
        for b in batches:
            for packed in b.column(0).to_pylist():
                w = np.frombuffer(packed, np.uint64)
                size = np.concatenate([np.full(n, n) for _, n in segments(len(w))])
                sets = (np.uint64(1) << (size - 1).astype(np.uint64)).view(np.int64)
                yield pa.record_batch([pa.array(w.view(np.int64)), pa.array(sets)], names=["word", "sizes"])

    found = items.select("words").mapInArrow(words, "word long, sizes long").groupBy("word").agg(F.bit_or("sizes").alias("sizes"))
    return items.select("item", "words").mapInArrow(keys, "key long, item long, offset long, size long"), found


def _power(n: int, most: int) -> int:
    return min(most, 1 << max(10, int(n - 1).bit_length()))


class Gate:
    """What the scan needs of the benchmark: sizes by word, the filter of keys, the sizes and the longest item."""

    def __init__(self, slots: np.ndarray, filter_: np.ndarray, sizes: list[int], longest: int, similarity: float):
        self.slots, self.filter, self.sizes, self.similarity = slots, filter_, sizes, similarity
        self.need = {n: n - allowed(n, similarity) for n in sizes}
        self.around = longest + allowed(longest, similarity)  # words of context that verification may ask for

    def sets(self, words: np.ndarray) -> np.ndarray:
        return np.where(words != 0, self.slots[(words & np.uint64(len(self.slots) - 1)).astype(np.int64)], np.uint64(0))

    def has(self, key: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.filter) * 8 - 1)
        found = np.ones(key.shape, bool)
        for k in (key & mask, key >> np.uint64(32) & mask):
            found &= (self.filter[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found

    def windows(self, words: np.ndarray):
        """(size, starts) of the windows that hold enough of the words of items of their size."""
        sets = self.sets(words)
        total = np.concatenate((np.zeros(1, np.int32), np.cumsum(sets != 0, dtype=np.int32)))
        some, edge = {}, np.zeros(len(words) + 1, np.int32)
        for n in self.sizes:  # first by the words of all sizes
            start = np.flatnonzero(total[n:] - total[:-n] >= self.need[n]) if n < len(total) else total[:0]
            start = start[words[start] != 0]
            if len(start):
                some[n] = start
                edge[start] += 1
                edge[start + n] -= 1
        held = np.cumsum(edge[:-1]) > 0  # the places that such windows cover; then by the words of a size alone
        rank, sets = np.concatenate((np.zeros(1, np.int32), np.cumsum(held, dtype=np.int32))), sets[held]
        for n, start in some.items():
            own = np.concatenate((np.zeros(1, np.int32), np.cumsum((sets >> np.uint64(n - 1)).astype(np.uint8) & np.uint8(1), dtype=np.int32)))
            place = rank[start]
            start = start[own[place + n] - own[place] >= self.need[n]]
            if len(start):
                yield n, start


def _gate(keys: DataFrame, words: DataFrame, items: DataFrame, similarity: float) -> Gate | None:
    row = items.agg(F.count("*").alias("n"), F.max("n").alias("longest")).first()
    if not row["n"]:
        return None
    sizes = sorted(r["size"] for r in keys.select("size").distinct().collect())  # 64 at most
    entries, n_keys = _power(8 * words.count(), SLOTS), keys.count()
    bits = _power(32 * n_keys, FILTER)
    slots = np.zeros(entries, np.uint64)
    found = words.groupBy(F.col("word").bitwiseAND(entries - 1).alias("slot")).agg(F.bit_or("sizes").alias("sizes")).toArrow()
    slots[found.column("slot").to_numpy()] = found.column("sizes").to_numpy().view(np.uint64)
    places = F.array(F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1))
    one = keys.select(F.explode(places).alias("bit")).select(F.shiftright("bit", 3).alias("byte"), F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), F.col("bit").bitwiseAND(7).cast("int") + 1).alias("bit"))
    found = one.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    filter_ = np.zeros(bits // 8, np.uint8)
    filter_[found.column("byte").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return Gate(slots, filter_, sizes, int(row["longest"]), similarity)


MARK = "struct<doc_id:long,h1:long,h2:long>"
STRETCHES = f"mark {MARK}, at long, words binary, hits array<struct<key:long,start:long>>"


def _marked(documents: DataFrame) -> DataFrame:
    """mark, text: a row is told by its id and 128 bits of hashes of its text, so that ids may be null or repeat."""
    mark = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(29), F.col("text")).alias("h2"))
    return documents.select(mark.alias("mark"), "text")


def _scan(documents: DataFrame, gate, walks: Walks) -> DataFrame:
    """Stretches of documents with windows whose key some segment has: mark, at (its first word), words, hits."""

    def run(batches):
        g = gate.value
        for b in batches:
            for first, texts in ts.text_batches(b.column(1), rows=1024):
                w, at = _words(texts)
                words, begin = _padded(w, at)
                found = list(g.windows(words))
                if not found:
                    continue
                start = np.unique(np.concatenate([s for _, s in found]))
                hit_key, hit_start = [], []
                for part in range(0, len(start), 4096):  # paths are held for so many starts at a time
                    some = start[part : part + 4096]
                    paths = walks.paths(words[some[0] : some[-1] + 2 * STEPS], some - some[0])
                    for n, s in found:
                        s = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], "right")]
                        if len(s):
                            which = np.searchsorted(some, s)
                            key = walks.keys(words[some[0] : some[-1] + 2 * STEPS], some - some[0], paths, which, n)
                            t, k = np.nonzero(g.has(key))
                            hit_key.append(key[t, k])
                            hit_start.append(s[k])
                key, place = np.concatenate(hit_key), np.concatenate(hit_start)
                if not len(key):
                    continue
                doc = np.searchsorted(begin, place, "right") - 1
                group = (doc << 32) + (place - begin[doc]) // STRETCH
                order = np.argsort(group, kind="stable")
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]))
                ids, ats, texts_, sizes, keys, starts = [], [], [], [], [], []
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    here = order[s:e]
                    d = int(doc[here[0]])
                    p = place[here] - begin[d]
                    low, high = max(0, int(p.min()) - g.around), min(int(at[d + 1] - at[d]), int(p.max()) + 2 * g.around + LONGEST)
                    ids.append(first + d)
                    ats.append(low)
                    texts_.append(words[begin[d] + low : begin[d] + high].tobytes())
                    sizes.append(len(here))
                    keys.append(key[here])
                    starts.append(p)
                hits = pa.StructArray.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(starts))], names=["key", "start"])
                hits = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), hits)
                yield pa.record_batch([b.column(0).take(pa.array(ids)), pa.array(ats, pa.int64()), pa.array(texts_, pa.binary()), hits], names=["mark", "at", "words", "hits"])

    rows = _marked(documents).mapInArrow(run, STRETCHES)
    return rows.select(F.monotonically_increasing_id().alias("stretch"), "mark", "at", "words", "hits")


def distance(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance of the pattern to any stretch of the text, and where the first such stretch ends."""
    m = len(pattern)
    full, top, places = (1 << m) - 1, 1 << m - 1, {}
    for k, p in enumerate(pattern):
        places[p] = places.get(p, 0) | 1 << k
    up, down, score = full, 0, m  # vertical steps of the table's column, as bit sets
    best, end = m, 0
    for j, c in enumerate(text, 1):
        same = places.get(c, 0)
        diagonal = ((same & up) + up ^ up) | same | down
        right_up, right_down = down | (full & ~(diagonal | up)), up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
            if score < best:
                best, end = score, j
        right_up, right_down = right_up << 1 & full, right_down << 1 & full
        up, down = right_down | (full & ~(same | down | right_up)), right_up & (same | down)
    return best, end


FOUND = f"mark {MARK}, item long, item_id long, distance int, end_word int, item_words int"


def _verify(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (mark, item, item_id, at, words, item_words, starts) within the edits."""

    def run(batches):
        for b in batches:
            place, out = [], []
            columns = [b.column(k) for k in range(3, 7)]
            for k in range(b.num_rows):
                at, words, item, starts = (c[k].as_py() for c in columns)
                words, pattern = np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64).tolist()
                n, d = len(pattern), allowed(len(pattern), similarity)
                best, starts = None, np.unique(starts)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(starts) > n) + 1, [len(starts)]))
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):  # windows that lie close are looked at together
                    low, high = max(0, int(starts[s]) - d - at), max(0, int(starts[e - 1]) + n + d - at)
                    found, end = distance(pattern, words[low:high].tolist())
                    if found <= d:
                        best = min(best or (found, at + low + end), (found, at + low + end))
                if best:
                    place.append(k)
                    out.append((*best, n))
            at = pa.array(place, pa.int64())
            yield pa.record_batch([*(b.column(k).take(at) for k in range(3)), *(pa.array([o[k] for o in out], pa.int32()) for k in range(3))], names=["mark", "item", "item_id", "distance", "end_word", "item_words"])

    return pairs.mapInArrow(run, FOUND)


def matches(documents: DataFrame, benchmark: DataFrame, similarity: float = 0.8, walks: int = 4, tables: int = 8, places: int = 2) -> DataFrame:
    """mark (doc_id and hashes of the text), item, item_id, distance, end_word, item_words: one row for each stretch of a document and item."""
    spark = documents.sparkSession
    bounded_batches(spark)
    plan = Walks(walks, tables, places)
    items, _ = stored(_items(benchmark, similarity), "items")
    keys, words = _item_keys(items, plan)
    keys, words = stored(keys, "item-keys")[0], stored(words, "item-words")[0]
    gate = _gate(keys, words, items, similarity)
    if gate is None:
        return spark.createDataFrame([], FOUND)
    found, _ = stored(_scan(documents, spark.sparkContext.broadcast(gate), plan), "stretches")
    hits = found.select("stretch", F.explode("hits").alias("hit")).select("stretch", "hit.key", "hit.start")
    met = hits.join(keys, "key").select("stretch", "item", (F.col("start") - F.col("offset")).alias("start"))
    met = met.groupBy("stretch", "item").agg(F.collect_set("start").alias("starts"))
    pairs = met.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item").join(found.select("stretch", "mark", "at", "words"), "stretch")
    return _verify(pairs.select("mark", "item", "item_id", "at", "words", "item_words", "starts"), similarity)


def contaminations(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document (an id and a text) and item it holds: doc_id, item_id, distance (word edits), item_words, end_word."""
    best = matches(documents, benchmark, **options).groupBy("mark", "item").agg(F.first("item_id").alias("item_id"), F.min(F.struct("distance", "end_word", "item_words")).alias("best"))
    return best.select("mark.doc_id", "item_id", "best.distance", "best.end_word", "best.item_words")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``documents`` without the rows whose text holds a benchmark item, whatever their ids."""
    gone = matches(documents, benchmark, **options).select("mark.h1", "mark.h2").distinct()
    held = documents.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(29), F.col("text")).alias("h2"))
    return held.join(gone, ["h1", "h2"], "left_anti").select("doc.*")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminations(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
