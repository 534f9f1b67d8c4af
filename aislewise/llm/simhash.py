"""Near duplicates by SimHash over one Gray-order hierarchical index.

All distinct fingerprints are sorted by Gray rank, over range partitions. In that order neighbours share long runs of
bits, so each run of fingerprints is a node that holds (mask, pattern): the bits that all below it share. Nodes are
grouped into upper nodes in the same way, up to one root. The search starts at the pair (root, root) and goes down from
pairs of nodes to pairs of their children; a pair is left out as soon as the differences summed over the bits that both
share pass max_bits. Spark walks the upper levels as joins of node tables, and fingerprints are shipped only to those
pairs of lowest shared nodes that are left; inside such a pair a task walks the lower levels, down to leaves of a few
fingerprints. Only links of a spanning forest leave a pair, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components, join_counted

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Fingerprints of one lowest shared node, and of one row that carries them.
NODE, ROW = 1 << 16, 1 << 10
#: Fingerprints below one leaf inside a task, and children of any upper node (a power of two).
LEAF, FANOUT = 16, 8
#: Node pairs and leaf pairs handled together in a task.
_PAIRS = 1 << 11
_CHUNK = 1 << 16
_FAN_BITS = FANOUT.bit_length() - 1


# ---- fingerprints -------------------------------------------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text with A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `shingle` words joined by spaces, repeats included; of all words where they are fewer."""
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words or [b""]), np.int64, max(1, len(words))))
    starts, stops, digest = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist(), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a whole text; 0 without a word."""
    words = words_of(text)
    return majority_bits(shingle_hashes(words, shingle, seed)) if words else 0


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) per row; a null, empty or blank text has fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])

    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema[0].dataType.simpleString()}, fp long")


# ---- the index ----------------------------------------------------------------------------------------------------


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the order of the reflected binary Gray code."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(fp: Column) -> Column:
    """gray_rank() of a long that holds 64 bits, as a long of the same order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _rows_of(row: int):
    """Sorted fingerprints of a partition as rows of up to `row`: part, start, n, ones, zeros (bits all share), fps."""

    def emit(part: int, start: int, fp: np.ndarray) -> pa.RecordBatch:
        ends = np.arange(0, len(fp), row)
        ones, zeros = np.bitwise_and.reduceat(fp, ends), np.bitwise_and.reduceat(~fp, ends)
        size = np.diff(np.r_[ends, len(fp)])
        columns = [np.full(len(ends), part), start + ends, size, ones.view(np.int64), zeros.view(np.int64)]
        arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array([fp[e : e + n].tobytes() for e, n in zip(ends, size)], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "start", "n", "ones", "zeros", "fps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, held = TaskContext.get().partitionId(), 0, np.zeros(0, np.uint64)
        for batch in batches:
            held = np.r_[held, batch.column(0).to_numpy().view(np.uint64)]
            full = len(held) - len(held) % row
            if full:
                yield emit(part, start, held[:full])
                start, held = start + full, held[full:]
        if len(held):
            yield emit(part, start, held)

    return run


def _indexed(distinct: DataFrame, node: int, row: int) -> tuple[DataFrame, str]:
    """Rows (node, at, ones, zeros, fps): the fingerprints in Gray order, node after node; at is a row's place in all."""
    ordered = distinct.select("fp").withColumn("rank", gray_order(F.col("fp"))).repartitionByRange("rank").sortWithinPartitions("rank").select("fp")
    rows, path = common.stored(ordered.mapInArrow(_rows_of(row), "part long, start long, n long, ones long, zeros long, fps binary"), "simhash-rows")
    sizes = rows.groupBy("part").agg(F.sum("n").alias("n"))  # one row a partition
    before = F.broadcast(sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before")))
    placed = rows.join(before, "part").withColumn("at", F.col("before") + F.col("start"))
    return placed.select(F.floor(F.col("at") / node).alias("node"), "at", "ones", "zeros", "fps"), path


def _levels(rows: DataFrame) -> tuple[list[DataFrame], str]:
    """Node tables (node, ones, zeros) from the lowest shared level to the root, and the path of the lowest."""
    shared = F.bit_and("ones").alias("ones"), F.bit_and("zeros").alias("zeros")
    lowest, path = common.stored(rows.groupBy("node").agg(*shared), "simhash-nodes")
    last = lowest.agg(F.max("node")).first()[0]
    levels = [lowest]
    while last:
        levels.append(levels[-1].groupBy(F.shiftright("node", _FAN_BITS).alias("node")).agg(*shared))
        last >>= _FAN_BITS
    return levels, path


def _node_pairs(levels: list[DataFrame], max_bits: int) -> DataFrame:
    """Pairs (a, b), a <= b, of lowest shared nodes that may hold linked fingerprints, found from the root down."""
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in levels[-2::-1]:
        child = lambda side: level.select(
            F.shiftright("node", _FAN_BITS).alias(side), F.col("node").alias(f"{side}_node"), F.col("ones").alias(f"{side}_ones"), F.col("ones").bitwiseOR(F.col("zeros")).alias(f"{side}_mask")
        )
        differ = F.col("a_ones").bitwiseXOR(F.col("b_ones")).bitwiseAND(F.col("a_mask")).bitwiseAND(F.col("b_mask"))
        below = pairs.join(child("a"), "a").join(child("b"), "b").where((F.col("a_node") <= F.col("b_node")) & (F.bit_count(differ) <= max_bits))
        pairs = below.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return pairs


# ---- search inside a pair of nodes --------------------------------------------------------------------------------


def gray_tree(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (shared mask, shared pattern) over fingerprints in Gray order, leaves first, one root last."""
    levels, starts = [], np.arange(0, len(fp), LEAF)
    ones, zeros = np.bitwise_and.reduceat(fp, starts), np.bitwise_and.reduceat(~fp, starts)
    while True:
        levels.append((ones | zeros, ones))
        if len(ones) == 1:
            return levels
        up = np.arange(0, len(ones), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(ones, up), np.bitwise_and.reduceat(zeros, up)


def _leaf_pairs(left: list, right: list, same: bool, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that may hold linked fingerprints, depth first and some at a time."""
    top = max(len(left), len(right)) - 1
    left, right = (tree + tree[-1:] * (top + 1 - len(tree)) for tree in (left, right))
    root, fan = np.zeros(1, np.int64), np.arange(FANOUT)
    todo = [(top, root, root)]
    while todo:
        depth, a, b = todo.pop()
        (a_mask, a_own), (b_mask, b_own) = left[depth], right[depth]
        near = np.bitwise_count((a_own[a] ^ b_own[b]) & a_mask[a] & b_mask[b]) <= max_bits
        a, b = a[near], b[near]
        if not depth:
            if len(a):
                yield a, b
            continue
        n_left, n_right = len(left[depth - 1][0]), len(right[depth - 1][0])
        for i in range(0, len(a), _PAIRS):
            x = (a[i : i + _PAIRS, None] * FANOUT + fan)[:, :, None]
            y = (b[i : i + _PAIRS, None] * FANOUT + fan)[:, None, :]
            x, y = np.broadcast_arrays(x, y)
            ok = (x < n_left) & (y < n_right) & ((x <= y) | (not same))
            todo.append((depth - 1, x[ok], y[ok]))


def _blocks(fp: np.ndarray) -> np.ndarray:
    """A row of LEAF fingerprints a leaf; the last one repeats until its row is full."""
    return np.r_[fp, np.repeat(fp[-1:], -len(fp) % LEAF)].reshape(-1, LEAF)


def _close(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: tuple[int, int], same: bool, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) within max_bits in the leaf pairs (a, b)."""
    hit = np.flatnonzero(np.bitwise_count(left[a][:, :, None] ^ right[b][:, None, :]) <= max_bits)
    pair, at = np.divmod(hit, LEAF * LEAF)
    i, j = a[pair] * LEAF + at // LEAF, b[pair] * LEAF + at % LEAF
    ok = (i < sizes[0]) & (j < sizes[1]) & ((i < j) | (not same))
    return i[ok], j[ok]


def search(fp: np.ndarray, other: np.ndarray | None = None, max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of all pairs within max_bits: i of fp, j of other, or i < j of fp alone; both in Gray order."""
    same = other is None
    other = fp if same else other
    left, right = _blocks(fp), _blocks(other)
    for a, b in _leaf_pairs(gray_tree(fp), gray_tree(other), same, max_bits):
        for k in range(0, len(a), _PAIRS):
            yield _close(a[k : k + _PAIRS], b[k : k + _PAIRS], left, right, (len(fp), len(other)), same, max_bits)


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest row of each component) after rows i and j are linked; label itself is used up."""
    while True:
        low = label.copy()
        u, v = low[i], low[j]
        np.minimum.at(low, u, v)
        np.minimum.at(low, v, u)
        while True:
            next_ = low[low]
            if (next_ == low).all():
                break
            low = next_
        if (low[i] == low[j]).all():
            return low
        label = low


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row that a pair names, its component's smallest row: at most one link a row instead of all pairs."""
    rows, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
    label = joined(np.arange(len(rows)), ends[: len(i)], ends[len(i) :])
    moved = label != np.arange(len(rows))
    return rows[moved], rows[label[moved]]


def spanning_links(fp: np.ndarray, other: np.ndarray | None = None, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links whose components are those of all pairs that search() finds, at most one a fingerprint.

    Leaf pairs whose fingerprints are in one component already are not compared, so a dense group costs few comparisons
    instead of their square.
    """
    same = other is None
    right_fp = fp if same else other
    left, right, sizes = _blocks(fp), _blocks(right_fp), (len(fp), len(right_fp))
    shift = 0 if same else len(left) * LEAF  # rows of other follow those of fp
    label = np.arange(len(left) * LEAF + (0 if same else len(right) * LEAF))
    label[sizes[0] : len(left) * LEAF] = sizes[0] - 1  # fillers repeat the last row
    if not same:
        label[shift + sizes[1] :] = shift + sizes[1] - 1
    low, high = label.reshape(-1, LEAF).min(axis=1), label.reshape(-1, LEAF).max(axis=1)

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label, low, high
        for k in range(0, len(a), _PAIRS):
            x, y = a[k : k + _PAIRS], b[k : k + _PAIRS]
            at = y + shift // LEAF
            apart = (low[x] != high[at]) | (high[x] != low[at])
            i, j = _close(x[apart], y[apart], left, right, sizes, same, max_bits)
            if len(i):
                label = joined(label, i, j + shift)
                low, high = label.reshape(-1, LEAF).min(axis=1), label.reshape(-1, LEAF).max(axis=1)

    if same:  # neighbours first: they unite dense groups
        leaf = np.arange(len(left))
        compare(np.r_[leaf, leaf[:-1]], np.r_[leaf, leaf[1:]])
    for a, b in _leaf_pairs(gray_tree(fp), gray_tree(right_fp), same, max_bits):
        compare(a, b)
    values = left.ravel() if same else np.r_[left.ravel(), right.ravel()]
    real = np.r_[np.arange(sizes[0]), shift + np.arange(0 if same else sizes[1])]
    moved = real[label[real] != real]
    return values[moved], values[label[moved]]


def _searched(max_bits: int):
    """Of rows (a, b, side, at, fps) sorted by node pair: links (a, b) between fingerprints, a pair of nodes at a time."""

    def links(sides: list[list[bytes]]) -> pa.RecordBatch:
        fp, other = (np.frombuffer(b"".join(own), np.uint64) if own else None for own in sides)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in spanning_links(fp, other, max_bits)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, [[], []]
        for batch in batches:
            a, b, side = (batch.column(k).to_pylist() for k in range(3))
            for now, at, fps in zip(zip(a, b), side, batch.column(4)):
                if now != key and key is not None:
                    yield links(sides)
                    sides = [[], []]
                key = now
                sides[at].append(fps.as_py())
        if key is not None:
            yield links(sides)

    return run


def hamming_links(distinct: DataFrame, max_bits: int = MAX_BITS, node: int = NODE, row: int = ROW) -> DataFrame:
    """Links (a, b) that connect all pairs of the distinct fingerprints fp within max_bits differing bits.

    Not every pair is a link, but the links' connected components are those of all pairs. node is the number of
    fingerprints that one side of a task holds, row that of one shipped row. An empty table gives no links.
    """
    rows, path = _indexed(distinct, node, row)
    levels, levels_path = _levels(rows)
    pairs, pairs_path = common.stored(_node_pairs(levels, max_bits), "simhash-pairs")
    own = rows.select("node", "at", "fps")
    left = pairs.join(own, pairs.a == own.node).select("a", "b", F.lit(0).alias("side"), "at", "fps")
    right = pairs.where("a <> b").join(own, F.col("b") == F.col("node")).select("a", "b", F.lit(1).alias("side"), "at", "fps")
    dealt = left.union(right).repartition("a", "b").sortWithinPartitions("a", "b", "side", "at")
    found, _ = common.stored(dealt.mapInArrow(_searched(max_bits), "a long, b long").where("a <> b").distinct(), "simhash-links")
    for used in (path, levels_path, pairs_path):
        common.remove(distinct.sparkSession, used)
    return found


# ---- documents ----------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) for each row of docs.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with a null doc_id get the
    component of their fingerprint; it is null only if nothing but null ids is in it. Repeated rows repeat. Equal
    fingerprints are one entry of the index, so copies are never paired. Empty tables give empty tables; other columns
    are not read.
    """
    fps, _ = common.stored(fingerprints(docs, text, doc_id, shingle), "simhash-fp")
    return labelled(fps, max_bits)


def labelled(fps: DataFrame, max_bits: int = MAX_BITS, links: DataFrame | None = None) -> DataFrame:
    """near_duplicates() of rows that have fp already; links (a, b) between fps stand in for those within max_bits.

    Fingerprints and components with many rows are joined by join_counted(), so none of them lands in one task.
    """
    distinct, _ = common.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots, _ = common.stored(components(hamming_links(distinct, max_bits) if links is None else links), "simhash-roots")
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member, _ = common.stored(rooted, "simhash-members")
    label = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    by_fp, _ = common.stored(join_counted(member, label, "root", "members").select("fp", "component_id", "n"), "simhash-labels")
    return join_counted(fps, by_fp, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs without those near copies whose component has a smaller doc_id; all columns stay.

    Rows that share the smallest doc_id of a component stay together (they are one document to this operator); rows
    with a null doc_id stay.
    """
    return without(docs, near_duplicates(docs, text, doc_id).where("doc_id <> component_id"), doc_id)


def without(docs: DataFrame, copies: DataFrame, doc_id: str) -> DataFrame:
    """The rows of docs whose id is no doc_id of copies; docs may have columns of any name."""
    gone = common.spare_name(docs, "near_copy")
    return docs.join(copies.select(F.col("doc_id").alias(gone)).distinct(), F.col(doc_id) == F.col(gone), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash_gray": query}
