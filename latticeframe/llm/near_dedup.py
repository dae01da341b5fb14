"""Near-duplicate documents by a chosen-path set similarity join (operator 8).

1. Every document becomes its set of word shingles, a min-wise signature and a 2-bit sketch of it.  Documents with
   equal sets fold into one representative, so exact copies never meet in a bucket.
2. Each of ``trees`` independent trees branches a representative: a node picks one of its level's signature
   positions, sometimes a second one (``1 / similarity`` on average, the chosen-path rule), and the document goes on to
   the child named by its min-wise token there.  The leaves ``depth`` levels down are the nodes that are compared.
   A node above ``node_limit`` rows is not branched further, which would lose pairs: it is dealt in blocks of about that
   many rows, each with the node's first document, so no task holds a large node.
3. Small nodes are compared exhaustively on sketches.  A larger node first links each member with its first and closest one;
   links are confirmed on full sets and joined into components; then all its pairs that lie in different components
   are compared on full sets too, in blocks, and only links come out: the rows outside the node's largest component go
   to all its blocks, or, where they are many, blocks meet in pairs.  So a group of thousands of copies costs a link
   or two each, and no pair that can still join two components is left out.
4. Candidates are confirmed on their full sets, and connected components are taken of the confirmed links.

With similarity .8, 12 trees of depth 4 missed 4 of 60,000 simulated pairs that agree in each position with chance .8; as
each tree deals the 128 positions in an order of its own, trees are nearly but not wholly independent.

Edge cases: a null or empty text, or one without words, has the empty set and is linked with nothing; a null doc_id
is kept as a row of its own with a null component; rows that share a doc_id are judged each by its own text; very long texts are hashed in chunks, and of ties the smallest doc_id stays; an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textsets as ts
from ._shared import bounded_batches, connected_components, remove, stored, tasks

POSITIONS = 128
SKETCH = [f"s{k}" for k in range(1, POSITIONS // 32 + 1)]  # columns of the 2-bit sketch
PER_LEVEL = 16  # positions that each level of a tree may choose from; levels of a path don't share any
SMALL = 8  # nodes up to this size are compared exhaustively at once
PAIRED = 8192  # in nodes up to this size each member is at first linked with its closest one, too


def _choose(node: np.ndarray, level: int, similarity: float, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that nodes select at a level: rows, positions; a second one with chance 1 / similarity - 1."""
    slots = POSITIONS // PER_LEVEL
    dice = ts.mix(node + np.uint64(level + 1))
    block = level % slots * PER_LEVEL
    first = dice % np.uint64(PER_LEVEL)
    second = (first + np.uint64(1) + (dice >> np.uint64(8)) % np.uint64(PER_LEVEL - 1)) % np.uint64(PER_LEVEL)
    more = np.flatnonzero((dice >> np.uint64(40)).astype(np.float64) / 2.0**24 < 1 / similarity - 1)
    rows = np.concatenate((np.arange(len(node)), more))
    return rows, order[block + np.concatenate((first, second[more])).astype(np.int64)]


def branch(node: np.ndarray, doc: np.ndarray, sig: np.ndarray, level: int, similarity: float, order: np.ndarray):
    """One level: the children (node ids) that the rows go on to, and the row of ``sig`` each belongs to."""
    rows, position = _choose(node, level, similarity, order)
    doc = doc[rows]
    token = sig[doc, position].astype(np.uint64)
    return ts.mix(node[rows] ^ ts.mix((token << np.uint64(8)) + position.astype(np.uint64))), doc


def leaves(sig: np.ndarray, trees: int, depth: int, similarity: float) -> list[np.ndarray]:
    """The leaf nodes of every signature, over all trees; each tree deals the positions to its levels in an order of its own."""
    n = len(sig)
    out_node, out_doc = [], []
    for tree, root in enumerate(ts.mix(np.arange(7000, 7000 + trees, dtype=np.uint64))):
        order = np.random.default_rng((19, tree)).permutation(POSITIONS)
        node, doc = np.full(n, root), np.arange(n)
        for level in range(depth):
            node, doc = branch(node, doc, sig, level, similarity, order)
        out_node.append(node)
        out_doc.append(doc)
    node, doc = np.concatenate(out_node), np.concatenate(out_doc)
    order = np.argsort(doc, kind="stable")
    return np.split(node[order], np.cumsum(np.bincount(doc, minlength=n))[:-1])


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits of each min-wise value, as 64-bit words of 32 values."""
    two = (sig & np.uint32(3)).astype(np.uint64).reshape(len(sig), -1, 32)
    return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the two-bit fields agree, by broadcasting over all but the last axis."""
    x = a ^ b
    x = (x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return POSITIONS - np.bitwise_count(x).sum(-1, dtype=np.int64)


def least_agreement(similarity: float) -> int:
    """Fields that a pair at the threshold agrees on, less four standard deviations."""
    p = similarity + (1 - similarity) / 4
    return max(1, int(POSITIONS * p - 4 * (POSITIONS * p * (1 - p)) ** 0.5))


def _may_link(sk: np.ndarray, size: np.ndarray, other_sk: np.ndarray, other_size: np.ndarray, similarity: float, least: int) -> np.ndarray:
    """Whether sketches agree enough and set sizes allow the similarity."""
    return (agreeing(sk, other_sk) >= least) & (np.minimum(size, other_size) >= (similarity - 1e-9) * np.maximum(size, other_size))


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    one = ts.mix(s)
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(ts.mix(one + np.uint64(17))).view(np.int64))


def profile(documents: DataFrame, width: int, similarity: float, trees: int, depth: int) -> DataFrame:
    """mark (doc_id and hashes of the text), n_shingles, fp1, fp2, the sketch's columns, nodes (leaf ids)."""
    schema = f"mark struct<doc_id:long,h1:long,h2:long>, n_shingles long, fp1 long, fp2 long, {', '.join(f'{c} long' for c in SKETCH)}, nodes array<long>"

    def run(batches):
        for batch in batches:
            for begin, texts in ts.text_batches(batch.column(1)):
                ids = batch.column(0).slice(begin, len(texts))
                sets = ts.shingle_sets(texts, width)
                sig = ts.signatures(sets, POSITIONS)
                sk = sketch(sig).view(np.int64)
                prints = [_fingerprint(s) for s in sets]
                nodes = leaves(sig, trees, depth, similarity)
                flat = np.concatenate([x if len(s) else x[:0] for x, s in zip(nodes, sets, strict=True)] or [np.empty(0, np.uint64)])
                offsets = np.concatenate(([0], np.cumsum([len(x) if len(s) else 0 for x, s in zip(nodes, sets, strict=True)]))).astype(np.int32)
                yield pa.record_batch([
                    ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                    *(pa.array(c) for c in np.ascontiguousarray(sk.T)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
                ], names=["mark", "n_shingles", "fp1", "fp2", *SKETCH, "nodes"])

    mark = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *_hashes())
    return documents.select(mark.alias("mark"), "text").mapInArrow(run, schema).select("mark.*", "n_shingles", "fp1", "fp2", *SKETCH, "nodes")


def _hashes() -> list:
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(29), F.col("text")).alias("h2")]


def _node():
    return F.xxhash64("doc_id", "h1", "h2")


def _dealt(rows: DataFrame, big: DataFrame, node_limit: int) -> DataFrame:
    """``rows`` with the cell that each is compared in first: its node, or a block of a node over ``node_limit`` rows.

    ``big`` holds those nodes, with their rows and smallest doc; that doc goes to all blocks, which links them.
    """
    part, parts = F.pmod(F.xxhash64("doc"), "parts"), F.ceil(F.col("count") / node_limit)
    split = rows.join(big.withColumn("parts", parts), "node")
    at = F.when(F.col("doc") == F.col("lead"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(part))
    split = split.withColumn("part", F.explode(at)).select(F.xxhash64("node", "part").alias("cell"), "node", "doc", "n", *SKETCH)
    whole = rows.join(big, "node", "left_anti").select(F.col("node").alias("cell"), "node", "doc", "n", *SKETCH)
    return whole.unionAll(split)


def _in_cells(rows: DataFrame, node_limit: int) -> DataFrame:
    """Rows (node, comp, doc, n, sketch) of nodes with several components, by the cells in which all pairs of different ones meet.

    A node of up to ``node_limit`` rows is a cell.  A larger one is dealt in blocks; the rows outside its largest component
    go to every block if they are at most ``node_limit``, else every pair of blocks is a cell.
    """
    sizes = rows.groupBy("node", "comp").agg(F.count("*").alias("c"))
    whole = sizes.groupBy("node").agg(F.sum("c").alias("count"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    dealt = rows.join(whole.select("node", "count", F.col("top.comp").alias("main"), (F.col("count") - F.col("top.c")).alias("few")), "node")
    parts = F.ceil(F.col("count") / node_limit)
    dealt = dealt.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("doc"), "parts"))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    paired = (F.col("few") > node_limit) & (F.col("parts") > 1)
    everywhere = ~paired & (F.col("comp") != F.col("main"))
    other = F.when(paired, F.filter(blocks, lambda x: x != F.col("own"))).when(everywhere, blocks).otherwise(F.array("own"))
    dealt = dealt.withColumn("paired", paired).withColumn("other", F.explode(other))
    pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    cell = F.when(F.col("paired"), pair).when(F.col("parts") > 1, F.xxhash64("node", "other")).otherwise(F.col("node"))
    return dealt.select(cell.alias("node"), "comp", "doc", "n", *SKETCH)


def _groups(batches, columns: int):
    """Runs of equal first column over sorted Arrow batches: lists of numpy columns, one run at a time."""
    rest = None
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cuts = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        bounds = np.concatenate(([0], cuts))
        long = np.flatnonzero(np.diff(bounds) > 1)
        for k in long:
            yield [c[bounds[k] : bounds[k + 1]] for c in cols]
        rest = [c[bounds[-1] :] for c in cols]
    if rest is not None and len(rest[0]) > 1:
        yield rest


def _closest(sk: np.ndarray, size: np.ndarray, similarity: float, least: int) -> np.ndarray:
    """For each row the other row that may link with it and agrees most, -1 for none; a block of rows at a time."""
    best = np.full(len(sk), -1)
    block = max(1, (1 << 17) // len(sk))
    for s in range(0, len(sk), block):
        agree = agreeing(sk[s : s + block, None], sk[None])
        fits = np.minimum(size[s : s + block, None], size) >= (similarity - 1e-9) * np.maximum(size[s : s + block, None], size)
        agree[~fits] = 0
        agree[np.arange(len(agree)), np.arange(s, s + len(agree))] = 0
        top = agree.argmax(1)
        ok = agree[np.arange(len(agree)), top] >= least
        best[s : s + block][ok] = top[ok]
    return best


def _candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """kind 0: a candidate pair (a < b); kind 1: a row of a larger node that is to be looked at again (a = node, b = doc)."""
    least = least_agreement(similarity)
    names = ["kind", "a", "b", "n", *SKETCH]

    def run(batches):
        for cell, node, doc, n, *words in _groups(batches, 4 + len(SKETCH)):
            new = np.concatenate(([True], doc[1:] != doc[:-1]))  # rows that repeat both id and text
            cell, node, doc, n, *words = (c[new] for c in (cell, node, doc, n, *words))
            sk = np.stack(words, 1).view(np.uint64)
            if len(doc) <= SMALL:
                i, j = np.triu_indices(len(doc), 1)
                ok = _may_link(sk[i], n[i], sk[j], n[j], similarity, least)
                i, j = i[ok], j[ok]
                again = j[:0]
            else:
                j = np.flatnonzero(_may_link(sk[1:], n[1:], sk[:1], n[:1], similarity, least)) + 1
                i, again = np.zeros(len(j), np.int64), np.arange(len(doc))
                if len(doc) <= PAIRED:  # also each member with the one it agrees with most
                    best = _closest(sk, n, similarity, least)
                    again = np.flatnonzero(best >= 0)
                    i, j = np.concatenate((i, again)), np.concatenate((j, best[again]))
            if cell[0] != node[0]:  # a block: its rows may link with other blocks'
                again = np.arange(len(doc))
            if len(j) or len(again):
                row = np.concatenate((j, again))
                kind = np.repeat(np.array([0, 1], np.int8), [len(j), len(again)])
                first = np.concatenate((np.minimum(doc[i], doc[j]), node[again]))
                second = np.concatenate((np.maximum(doc[i], doc[j]), doc[again]))
                yield pa.record_batch([pa.array(kind), pa.array(first), pa.array(second), pa.array(n[row]), *(pa.array(w[row]) for w in words)], names=names)

    return nodes.mapInArrow(run, "kind byte, " + ", ".join(f"{c} long" for c in names[1:]))


def _open(rows: DataFrame, similarity: float, cell_rows: int) -> DataFrame:
    """Rows that may still link with a row of another component of their node: cell, comp, doc, n, sketch.

    ``rows``: node, comp, doc, n, sketch, sorted.  A cell is a node, or for more than ``cell_rows`` rows a pair of its blocks.
    """
    least = least_agreement(similarity)
    names = ["cell", "comp", "doc", "n", *SKETCH]

    def run(batches):
        for node, comp, doc, n, *words in _groups(batches, 4 + len(SKETCH)):
            sk = np.stack(words, 1).view(np.uint64)
            label, counts = np.unique(comp, return_counts=True)
            hit = np.zeros(len(doc), bool)
            for k in np.flatnonzero(comp != label[counts.argmax()]):  # one row against all: linear memory
                may = _may_link(sk, n, sk[k], n[k], similarity, least) & (comp != comp[k])
                if may.any():
                    hit |= may
                    hit[k] = True
            at = np.flatnonzero(hit)
            blocks = -(-len(at) // cell_rows)
            for p in range(blocks):
                for q in range(p + (blocks > 1), max(blocks, p + 1)):
                    some = np.concatenate([at[x * cell_rows : (x + 1) * cell_rows] for x in sorted({p, q})])
                    cell = ts.mix(node[some].view(np.uint64) + np.uint64(p * 1_000_003 + q)).view(np.int64)
                    yield pa.record_batch([pa.array(cell), pa.array(comp[some]), pa.array(doc[some]), pa.array(n[some]), *(pa.array(w[some]) for w in words)], names=names)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _links_across(cells: DataFrame, documents: DataFrame, width: int, similarity: float) -> DataFrame:
    """Confirmed links (a < b) between components of one cell; pairs within what is already joined are skipped.

    ``cells`` as ``_open`` returns them.  Each document's set is made once and travels to its cells.
    """
    least, share, names = least_agreement(similarity), Fraction(str(similarity)), ["cell", "comp", "n", *SKETCH]
    struct = ",".join(f"{c}:long" for c in names)
    roles = cells.groupBy("doc").agg(F.collect_list(F.struct(*names)).alias("roles"))
    sets = _sets(documents, roles, f"array<struct<{struct}>>", width)
    dealt = sets.select("doc", "set", F.explode("roles").alias("r")).select("r.*", "doc", "set").repartition(tasks(cells.sparkSession), "cell").sortWithinPartitions("cell", "comp", "doc")

    def run(batches):
        for _, comp, n, *words, doc, packed in _groups(batches, 5 + len(SKETCH)):
            sk = np.stack(words, 1).view(np.uint64)
            sets = [np.frombuffer(x, np.uint64) for x in packed]
            label, comp, counts = np.unique(comp, return_inverse=True, return_counts=True)
            largest, joined, found = counts.argmax(), np.arange(len(label)), []
            for k in np.flatnonzero(comp != largest):
                other = (comp == largest) | (np.arange(len(doc)) > k)
                for j in np.flatnonzero(_may_link(sk, n, sk[k], n[k], similarity, least) & other):
                    if joined[comp[j]] != joined[comp[k]]:
                        both = _common(sets[k], sets[j])
                        if both and share.denominator * both >= share.numerator * (len(sets[k]) + len(sets[j]) - both):
                            joined[joined == joined[comp[j]]] = joined[comp[k]]
                            found.append((min(doc[k], doc[j]), max(doc[k], doc[j])))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _sets(documents: DataFrame, roles: DataFrame, kind: str, width: int) -> DataFrame:
    """doc, set (sorted shingle hashes), roles for each document of ``roles``."""
    marked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_hashes(), "text")
    texts = marked.select(_node().alias("doc"), "text").join(roles, "doc")

    def run(batches):
        for b in batches:
            for begin, found in ts.text_batches(b.column(1)):
                packed = [s.tobytes() for s in ts.shingle_sets(found, width)]
                yield pa.record_batch([b.column(0).slice(begin, len(found)), pa.array(packed, pa.binary()), b.column(2).slice(begin, len(found))], names=["doc", "set", "roles"])

    return texts.select("doc", "text", "roles").mapInArrow(run, f"doc long, set binary, roles {kind}")


def _verify(pairs: DataFrame, documents: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose full sets reach the similarity.  A set travels once for each pair it is the member of, and once
    for each 512 pairs it leads; a document that leads many pairs is dealt over as many tasks."""
    share = Fraction(str(similarity))
    n = tasks(pairs.sparkSession)
    led = pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).alias("parts"))
    member = pairs.join(led, "a").select(F.col("b").alias("doc"), F.col("a").alias("lead"), F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(1).alias("member"))
    lead = led.select(F.col("a").alias("doc"), F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    roles = member.unionAll(lead).groupBy("doc").agg(F.collect_list(F.struct("lead", "part", "member")).alias("roles"))
    sets = _sets(documents, roles, "array<struct<lead:long,part:long,member:int>>", width)
    dealt = sets.select("doc", "set", F.explode("roles").alias("r")).select("r.lead", "r.part", "r.member", "doc", "set")
    dealt = dealt.repartition(n, "lead", "part").sortWithinPartitions("lead", "part", "member", "doc")

    def confirm(batches):
        key, leader = None, None
        for b in batches:
            a, c = [], []
            for lead, part, member, doc, data in zip(*(b.column(k).to_pylist() for k in range(4)), b.column(4), strict=True):
                s = np.frombuffer(data.as_buffer(), np.uint64)
                if not member:
                    key, leader = (lead, part), s.copy()
                elif key == (lead, part):
                    both = _common(leader, s)
                    if both and share.denominator * both >= share.numerator * (len(leader) + len(s) - both):
                        a.append(lead)
                        c.append(doc)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(confirm, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(x) else 0


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id it reaches), kept."""
    return _labelled(documents, **options).select("doc_id", "n_shingles", "component_id", "kept")


def _labelled(documents: DataFrame, width: int = 5, similarity: float = 0.8, trees: int = 12, depth: int = 4, node_limit: int = 256, cell_rows: int = 2048) -> DataFrame:
    """``near_duplicates`` with h1 and h2, the hashes of the row's text."""
    spark = documents.sparkSession
    bounded_batches(spark)
    n = tasks(spark)
    base, _ = stored(profile(documents, width, similarity, trees, depth), "profile")
    # a node of the graph is a row's id and text, as ``_node`` hashes them, so that rows which share an id are apart
    reps = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("m"))
    reps = reps.select("fp1", "fp2", "n_shingles", F.col("m.doc_id").alias("first"), F.xxhash64("m.doc_id", "m.h1", "m.h2").alias("doc"))
    own = base.where("n_shingles > 0 AND doc_id IS NOT NULL").join(reps, ["fp1", "fp2", "n_shingles"]).where(_node() == F.col("doc"))
    rows = own.select(F.explode(F.array_distinct("nodes")).alias("node"), "doc", F.col("n_shingles").alias("n"), *SKETCH)
    big = rows.groupBy("node").agg(F.count("*").alias("count"), F.min("doc").alias("lead")).where(F.col("count") > node_limit)
    big, big_path = stored(big, "big")
    paths = [big_path]
    nodes = _dealt(rows, big, node_limit).repartition(n, "cell").sortWithinPartitions("cell", "doc")
    found, found_path = stored(_candidates(nodes, similarity), "candidates")
    pairs = found.where("kind = 0").select("a", "b").distinct()
    links, links_path = stored(_verify(pairs, documents, width, similarity), "links")
    paths += [found_path, links_path]
    again = found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("doc"), "n", *SKETCH)
    if not again.isEmpty():
        comps = connected_components(links)
        labelled = again.join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc"))
        open_rows = _in_cells(labelled.select("node", "comp", "doc", "n", *SKETCH).distinct(), node_limit).repartition(n, "node").sortWithinPartitions("node", "comp", "doc")
        cells, cells_path = stored(_open(open_rows, similarity, cell_rows), "cells")
        links, links_path = stored(links.unionAll(_links_across(cells, documents, width, similarity)), "links")
        paths += [cells_path, links_path]
    label, _ = stored(connected_components(links).withColumnRenamed("node", "doc"), "labels")
    remove(spark, *paths)
    named = reps.join(label, "doc", "left").select("fp1", "fp2", "n_shingles", "first", F.coalesce("component", "doc").alias("comp"))
    named = named.join(named.groupBy("comp").agg(F.min("first").alias("component")), "comp").drop("comp", "first")
    out = base.select("doc_id", "h1", "h2", "n_shingles", "fp1", "fp2").join(named, ["fp1", "fp2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "h1", "h2", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``documents`` with one document of each group of near duplicates: the one with the smallest doc_id.

    Rows go by their id and the hashes of their text, so a row that only shares its id with a duplicate stays.
    """
    gone = _labelled(documents, width=width, similarity=similarity).where("NOT kept").select("doc_id", "h1", "h2").distinct()
    held = documents.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), *_hashes())
    return held.join(gone, ["doc_id", "h1", "h2"], "left_anti").select("doc.*")


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, similarity=0.8)


#: A counting join over all shingles and a recursive walk over the links: for small tables.  Copies are folded first.
OP8_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id::BIGINT AS doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM words
), reps AS (SELECT s, len(s) AS n, min(doc_id) AS doc FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT doc, n, unnest(s) AS g FROM reps),
links AS (
  SELECT a.doc AS a, b.doc AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc < b.doc AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc, b.doc, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc AS a, doc AS b FROM reps UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least_of AS (SELECT a AS doc, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN reps ON sets.s = reps.s AND len(sets.s) > 0 LEFT JOIN least_of ON least_of.doc = reps.doc
"""
