"""Best-fit packing by patterns: a few lengths that fill a sequence, repeated as non-negative least squares tells.

The corpus meets the driver as a histogram of lengths only, one count for each length up to the window. Patterns of up
to three lengths are fitted to it and rounded; what they leave is packed by best fit over the same counts. Documents then
find their places in parallel: the k-th piece of a length takes the k-th place that the plan has for that length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .packing import tokenizer_encoder

WINDOW, END_ID = 1024, 2
#: Lengths of a pattern: three up to this window, two beyond, so that patterns stay under 400,000.
THREE_UP_TO = 2048
#: Projected gradient steps of the fit, and shares of the fitted repeats that are tried: the rest is left to best fit.
STEPS, SHARES = 300, (1.0, 0.95, 0.75, 0.5, 0.25)


# ---- patterns on a histogram --------------------------------------------------------------------------------------


def patterns(counts: np.ndarray) -> np.ndarray:
    """All rows (a, b, c), a >= b >= c >= 0, of lengths that occur and add up to the window, len(counts) - 1; 0: no length."""
    window = len(counts) - 1
    there = np.flatnonzero(counts[:window])
    there = there[there > 0]
    out = [np.zeros((0, 3), np.int64)]
    here = np.zeros(window + 1, bool)
    here[there] = True
    for c in np.concatenate([[0], there]) if window <= THREE_UP_TO else [0]:
        b = there[(there >= c) & (2 * there <= window - c)]
        a = window - c - b
        ok = here[a] & (a >= b)
        out.append(np.stack([a[ok], b[ok], np.full(ok.sum(), c)], axis=1))
    return np.concatenate(out)


def fit_repeats(found: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of each pattern with the least sum of squares of length * (used - counts), by projected gradients.

    Long pieces weigh more: what is left of short ones fills gaps anywhere. Steps are accelerated and start anew
    whenever the sum of squares grows.
    """
    size = len(counts)
    weight = np.arange(size, dtype=float) / (size - 1)
    target = weight * counts

    def used(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(found[:, k], x, size) for k in range(3))
        total[0] = 0
        return weight * total

    def back(y: np.ndarray) -> np.ndarray:
        y = weight * y
        return y[found[:, 0]] + y[found[:, 1]] + y[found[:, 2]]

    probe = np.ones(len(found))
    for _ in range(20):
        probe = back(used(probe))
        largest = np.linalg.norm(probe)
        probe /= largest
    step = 1 / (1.05 * largest)
    x = ahead = np.zeros(len(found))
    t, error = 1.0, np.inf
    for _ in range(steps):
        miss = used(ahead) - target
        now = float(miss @ miss)
        if now > error:
            ahead, t = x, 1.0
            error = np.inf
            continue
        error = now
        new = np.maximum(ahead - step * back(miss), 0.0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, x = new + (before - 1) / t * (new - x), new
    return x


def _rounded(found: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats whose running sum follows that of x, cut to what is left of each length, which is taken away."""
    whole = np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0).astype(np.int64)
    out = []
    some = np.flatnonzero(whole)
    for i in some[np.argsort(-whole[some], kind="stable")]:
        pattern = tuple(int(v) for v in found[i] if v)
        need = Counter(pattern)
        repeats = min(int(whole[i]), *(int(left[v]) // k for v, k in need.items()))
        if repeats > 0:
            out.append((pattern, repeats))
            for v, k in need.items():
                left[v] -= k * repeats
    return out


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of the counts in left, longest first, over classes of equal sequences instead of single ones."""
    window = len(left) - 1
    by_free: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    frees = np.zeros(window + 1, bool)
    for size in range(window, 0, -1):
        todo = int(left[size])
        while todo:
            at = size + int(frees[size:].argmax())
            if not frees[at]:
                by_free[window].append(((), -(-todo // (window // size))))
                frees[window], at = True, window
            own, many = by_free[at].pop()
            each = min(at // size, todo)
            full = min(many, todo // each)
            todo -= each * full
            if many > full:
                by_free[at].append((own, many - full))
            frees[at] = bool(by_free[at])
            by_free[at - each * size].append((own + (size,) * each, full))
            frees[at - each * size] = True
    return [x for classes in by_free.values() for x in classes if x[0]]


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences): every length as often as counts says. counts[0] is not read.

    Patterns are fitted once; of several shares of the fitted repeats that which ends in the fewest sequences counts, as
    patterns that use up all short pieces leave nothing for the gaps of the others.
    """
    window, some = len(counts) - 1, np.array(counts, np.int64)
    some[[0, -1]] = 0
    found = patterns(some)
    repeats = fit_repeats(found, some) if len(found) else np.zeros(0)
    plans = []
    for share in SHARES:
        left = some.copy()
        own = _rounded(found, share * repeats, left)
        plans.append(own + best_fit(left))
    whole = [((window,), int(counts[-1]))] if counts[-1] else []
    return whole + min(plans, key=lambda p: sum(n for _, n in p))


@dataclass
class Places:
    """The plan's places in order of length and rank: those from starts[i] on are alike but for their sequence number."""

    before: np.ndarray  # places of shorter lengths
    starts: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank among the pieces of that length, from 0 on."""
        at = self.before[length] + rank
        i = np.searchsorted(self.starts, at, "right") - 1
        return self.sequence[i] + (at - self.starts[i]), self.offset[i]


def places(plan: list[tuple[tuple[int, ...], int]], counts: np.ndarray) -> Places:
    rows, sequence = [], 0
    for lengths, repeats in plan:
        at = 0
        for size in lengths:
            rows.append((size, repeats, sequence, at))
            at += size
        sequence += repeats
    size, repeats, number, offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    ends = np.cumsum(repeats)
    before = np.concatenate([[0, 0], np.cumsum(counts[1:-1])])
    return Places(before, ends - repeats, number, offset)


# ---- Spark --------------------------------------------------------------------------------------------------------


def tokenized_pieces(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, k (and ids): the pieces of each document, none placed yet.

    A document over the window is cut into whole windows behind a shorter first piece. k counts the pieces of one length
    in one task. Texts are encoded once, so the result should be stored before it is read twice.
    """
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "k"] + ["ids"] * with_ids
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, k long" + ", ids binary" * with_ids
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = tokenizer_encoder(shared.value), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for i in range(0, batch.num_rows, common.ROWS_AT_ONCE):
                part = batch.slice(i, common.ROWS_AT_ONCE)
                row, out = [], []
                for r, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    total = len(ids) // 4
                    ends = range(total % window or window, total + 1, window)
                    for piece, stop in enumerate(ends if total > window else [total]):
                        start = max(stop - window, 0)
                        own = ids[4 * start : 4 * stop]
                        row.append(r)
                        out.append((piece, start, stop - start, zlib.crc32(own), task, seen[stop - start]) + (own,) * with_ids)
                        seen[stop - start] += 1
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *columns], names=names)

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (with_ids: also ids).

    path: a tokenizer's JSON file of byte-level kind, read on the driver and broadcast. Null and empty texts are the end
    id alone; repeated rows and ids are documents of their own; a null doc_id stays null. An empty table gives an empty
    table; other columns are not read. Pieces are written to the shared folder once; the driver gets one count for each
    length, and tasks get the plan, whose size depends on the window alone (under 400,000 patterns of three numbers).
    The rank of a piece among those of its length is its task's first rank, found by a running sum over tasks, plus k:
    no length is one task, however many pieces have it.
    """
    spark = docs.sparkSession
    pieces, _ = common.stored(tokenized_pieces(docs, path, text, doc_id, window, end_id, with_ids), "pieces")
    per_task, _ = common.stored(pieces.groupBy("length", "task").agg(F.count("*").alias("own")), "piece-counts")
    counts = np.zeros(window + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("own").alias("all")).collect():
        counts[row.length] = row["all"]
    shared = spark.sparkContext.broadcast(places(plan(counts), counts))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("length", "task", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(firsts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank"), *["ids"] * with_ids)
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = own.of(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            columns = [*batch.columns[:5], *map(pa.array, found), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids)

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the whole sequences of what pack(with_ids=True) gave, ids as 32-bit integers in bytes."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most a window of tokens
    whole = F.aggregate(parts, F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the pieces of all documents; null and empty texts are one token, repeated rows are packed one by one."""
    return pack(common.table(spark, sf_dir, "documents"))


QUERIES = {"op13_pattern_packing": query}
