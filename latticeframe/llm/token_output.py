"""Token ids as binary shards with Elias-Fano document boundaries (operator 3).

Documents are range-partitioned by doc_id and sorted, each task encodes its run and writes shard files of at most
``shard_tokens`` ids (or one longer document).  A shard file holds a header, the doc_ids, the Elias-Fano coded
boundaries with one select sample for each 256 ones, and the concatenated ids at 2 or 4 bytes each.  The start of
document i is select(i) on the coded bits: no table of 64-bit offsets exists, on disk or in memory.  Shards are named by
their place in the order; where a shard begins among all ids follows from a prefix sum over shard lengths, in two levels.

A task writes a shard to a name of its own and renames it at the end, so a task that runs again replaces its shard by
the same bytes.  Readers get names and starts; a worker opens one shard at a time and reads its ids in runs of about
``RUN`` bytes.  Files go through pyarrow's file systems, at a path that all executors reach.

Edge cases: a null or empty text has no ids but the end id; null doc_ids come first; repeated doc_ids stay, in the
order of their texts' hashes and texts; a text of any length is one document, and a shard of its own beyond
``shard_tokens``; an empty table gives no shards and no rows; further columns are ignored.
"""

from __future__ import annotations

import os
import string
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, fresh_path, tasks

MAGIC = b"LFTOK001"
SAMPLE = 256
NULL_ID = -(1 << 63)
RUN = 1 << 20  # bytes of ids that a reader holds
RUN_PIECES = 1 << 13  # pieces between two looks at how much is remembered
HEAD = struct.Struct("<BBHQQQQQ")


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits an entry, with constant-time select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        plane = np.zeros((int(ones[-1]) + 1 if n else 0) + 7 & ~7, np.uint8)
        plane[ones] = 1
        return cls(n, width, low, np.packbits(plane, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bit = (self.low[at >> 3] >> (at & 7)) & 1
        return (bit.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """The i-th value."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        begin = i * self.low_bits
        low = int.from_bytes(self.low[begin >> 3 : (begin + self.low_bits + 7) >> 3].tobytes(), "little") >> (begin & 7)
        return (place - i << self.low_bits) + (low & (1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return (ones - i << self.low_bits) + self._low(i)


def pack_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    ef = EliasFano.encode(np.concatenate(([0], np.cumsum(lengths))))
    wide = vocabulary > 1 << 16
    body = ids.astype("<u4" if wide else "<u2").tobytes()
    head = MAGIC + HEAD.pack(4 if wide else 2, ef.low_bits, 0, len(doc_ids), len(ids), len(ef.low), len(ef.high), len(ef.samples))
    return head + doc_ids.astype("<i8").tobytes() + ef.low.tobytes() + ef.high.tobytes() + ef.samples.astype("<u4").tobytes() + body


class Shard:
    """A shard's index in memory, its ids read in runs as they are asked for."""

    def __init__(self, file):
        self.file, head = file, file.read(8 + HEAD.size)
        if head[:8] != MAGIC:
            raise ValueError("not a token shard")
        size, width, _, docs, self.tokens, low, high, samples = HEAD.unpack_from(head, 8)
        self.kind = np.dtype("<u4" if size == 4 else "<u2")
        index = file.read(8 * docs + low + high + 4 * samples)
        self.doc_ids = np.frombuffer(index, "<i8", docs)
        lo, hi = np.frombuffer(index, np.uint8, low, 8 * docs), np.frombuffer(index, np.uint8, high, 8 * docs + low)
        self.ends = EliasFano(docs + 1, width, lo, hi, np.frombuffer(index, "<u4", samples, 8 * docs + low + high))
        self.body = len(head) + len(index)

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(self.body + start * self.kind.itemsize)
        return np.frombuffer(self.file.read((end - start) * self.kind.itemsize), self.kind)

    def documents(self):
        """(doc_id, start, ids) of all documents in order; starts come from select."""
        first = last = 0
        run = np.empty(0, self.kind)
        start = self.ends.select(0) if len(self.doc_ids) else 0
        for i, doc in enumerate(self.doc_ids.tolist()):
            end = self.ends.select(i + 1)
            if end > last:
                first, last = start, min(self.tokens, max(end, start + RUN // self.kind.itemsize))
                run = self.ids(first, last)
            yield doc, start, run[start - first : end - first]
            start = end


#: Bytes with letters lowered and line feeds as spaces; and 1 for a letter of those, 2 for a punctuation mark other than an apostrophe.
_PLAIN = bytes(range(256)).lower().replace(b"\n", b" ")
_KIND = bytes(1 if c in string.ascii_lowercase else 2 if c in string.punctuation and c != "'" else 0 for c in map(chr, range(256)))
_encoders: dict = {}


#: Fixed values of the tokenizers whose pieces are independent: how they normalise and cut a text.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Longest piece that is remembered, bytes of all that is, and the most that a piece and its ids take as objects in a table.
PIECE_BYTES, MEMORY_BYTES, ENTRY_BYTES = 32, 1 << 27, 300


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer's own definition says that no id depends on text across a space, nor from a letter to a mark.

    It does if the text is put in composed form, white space folded and letters lowered one by one, and is then cut
    in runs of letters, single digits and runs of other marks, by the fixed pattern above.  A space, a line feed or a
    mark never composes with the ASCII letter or space before it.
    """
    import json

    with open(path, encoding="utf-8") as f:
        rule = json.load(f)
    cut = ((rule.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (rule.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and cut.get("type") == "Split" and cut.get("pattern") == {"Regex": _CUT} and cut.get("behavior") == "Removed" and cut.get("invert") is True and rule.get("post_processor") is None


class Memory(dict):
    """Ids of short pieces as bytes; a missing piece is taken from the former generation or encoded."""

    def __init__(self, encode, kind: str, former: dict):
        self.encode, self.kind, self.former = encode, kind, former

    def __missing__(self, piece: bytes) -> bytes:
        found = self.former.get(piece)
        if found is None:
            found = array(self.kind, self.encode(piece.decode())).tobytes()
        if len(piece) <= PIECE_BYTES:
            self[piece] = found
        return found


def cut(data: bytes) -> list[bytes]:
    """The pieces between spaces, and between a letter and a mark, of bytes that ``_PLAIN`` gave."""
    kind, plain = (np.frombuffer(b, np.uint8) for b in (data.translate(_KIND), data))
    edges = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
    return np.insert(plain, edges, 32).tobytes().split(b" ")


class Encoder:
    """The tokenizer over whole texts, remembering the ids of pieces between spaces.

    ``pieces`` takes effect for tokenizers whose definition allows it (``cuts_at_spaces``); all others, and texts that hold a
    special token's string, go to the library whole.  Ids are always the library's own.  The memory is two generations
    of pieces of at most PIECE_BYTES, together at most ``budget`` bytes; longer pieces are encoded each time.
    """

    def __init__(self, path: str, pieces: bool, budget: int = MEMORY_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # executors' cores are dealt by Spark
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.special = [t.content.encode().translate(_PLAIN) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.budget = pieces and cuts_at_spaces(path), budget
        self.known = self._generation({})

    def _generation(self, former: dict) -> Memory:
        return Memory(self._whole, "H" if self.kind is np.uint16 else "I", former)

    @classmethod
    def of(cls, path: str, pieces: bool) -> Encoder:
        """One encoder for each worker process, so that tasks share what it remembers."""
        if (path, pieces) not in _encoders:
            _encoders.clear()
            _encoders[path, pieces] = cls(path, pieces)
        return _encoders[path, pieces]

    def memory(self) -> int:
        """Bytes of what is remembered, at most."""
        return ENTRY_BYTES * (len(self.known) + len(self.known.former))

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # the same ids, without offsets

    def encode(self, text: str) -> np.ndarray:
        data = text.encode().translate(_PLAIN) if self.pieces else b""
        if not self.pieces or any(s in data for s in self.special):
            return np.array(self._whole(text), self.kind)
        parts, out = cut(data), []
        most = max(0, self.budget // 2 // ENTRY_BYTES - RUN_PIECES)
        for k in range(0, len(parts), RUN_PIECES):
            if len(self.known) > most:
                former, self.known.former = self.known, {}
                self.known = self._generation(former)
            out.append(b"".join(map(self.known.__getitem__, parts[k : k + RUN_PIECES])))
        return np.frombuffer(b"".join(out), self.kind)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")))


def _put(folder: str, name: str, data: bytes) -> str:
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    draft = f"{root}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, f"{root}/{name}")
    return name


def write_tokens(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2, shard_tokens: int = 1 << 22, pieces: bool = False) -> DataFrame:
    """Encode and write shards below ``folder``; returns the shards: part, seq, name, n_docs, n_tokens (written once, when run)."""
    n = tasks(documents.sparkSession)
    dealt = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        encoder, part = Encoder.of(tokenizer_path, pieces), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], encoder.kind)
        seq, size, ids, docs, lengths = 0, 0, [], [], []

        def flush():
            name = f"part-{part:06d}-{seq:06d}.lftok"
            _put(folder, name, pack_shard(np.array(docs, np.int64), np.array(lengths), np.concatenate(ids), encoder.vocabulary))
            return pa.record_batch([pa.array([part]), pa.array([seq]), pa.array([name]), pa.array([len(docs)]), pa.array([size])], names=["part", "seq", "name", "n_docs", "n_tokens"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                found = encoder.encode(text) if text else end[:0]
                if docs and size + len(found) > shard_tokens:
                    yield flush()
                    seq, size, ids, docs, lengths = seq + 1, 0, [], [], []
                ids += [found, end]
                docs.append(NULL_ID if doc is None else doc)
                lengths.append(len(found) + len(end))
                size += lengths[-1]
        if docs:
            yield flush()

    return dealt.mapInArrow(run, "part long, seq long, name string, n_docs long, n_tokens long")


def shard_starts(shards: DataFrame) -> DataFrame:
    """Adds ``start``: how many ids come before each shard.  Sums within parts first, then over the parts' totals."""
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("part") / 4096))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("block_n"))
    blocks = blocks.select("block", F.coalesce(F.sum("block_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("block_start"))
    before = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.join(blocks, "block").select("part", (F.col("block_start") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("part_start"))
    out = shards.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part")
    return out.withColumn("start", F.col("part_start") + F.col("inside")).drop("inside", "part_start")


def documents_of(shards: DataFrame, folder: str) -> DataFrame:
    """Rows (name, start) of shards below ``folder`` to one row a document: doc_id, start, n_tokens, ids_crc32, all from the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        store, root = _store(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    rows = []
                    for doc, start, ids in Shard(file).documents():
                        rows.append((None if doc == NULL_ID else doc, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 4096:
                            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                            rows = []
                    if rows:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return shards.select("name", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_round_trip(documents: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Write the shards, read the files back and return their documents."""
    spark = documents.sparkSession
    bounded_batches(spark)
    folder = folder or fresh_path(spark, "tokens")
    index = f"{folder}/index"
    write_tokens(documents, f"{folder}/shards", tokenizer_path, **options).write.parquet(index)
    shards = spark.read.parquet(index)
    n = shards.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    dealt = shard_starts(shards).select("name", "start").repartition(max(1, min(tasks(spark), n // 4)), "name")  # a few shards a task
    return documents_of(dealt, f"{folder}/shards")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokens_round_trip(documents, word_tokenizer(), end_id=2, pieces=True)
