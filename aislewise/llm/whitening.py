"""Embedding whitening: a compensated covariance over all distinct vectors, and the projection on its eigenvectors.

Sums are kept as pairs of doubles, high and low (double-double). Blocks of centred rows are cut into slices of so few
bits that the matrix products of two slices are exact in doubles; the products go into the pair with error-free sums.
Tasks return their pairs, which are merged pair by pair in a tree of tasks, so no order of tasks loses low parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE = 256
COMPONENTS = 4
#: Rows of one block: with slices of 21 bits, 2 * 20 + 10 bits hold any sum of a block exactly.
BLOCK, SLICE_BITS, SLICES = 1024, 21, 5
#: Partial sums that one task merges, and that the driver takes at most.
FAN_IN = 16

Pair = tuple[np.ndarray, np.ndarray]


# ---- error-free arithmetic ----------------------------------------------------------------------------------------


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(x: Pair, y: Pair) -> Pair:
    """The sum of two pairs, to about 100 bits."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(d: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """d + low as a sum of SLICES matrices of SLICE_BITS bits under each other, one scale for the whole block."""
    out, top = [], float(np.abs(d).max(initial=0.0))
    if top == 0.0:
        return out
    unit = 2.0 ** (np.ceil(np.log2(top)) + 1)
    rest = d
    for k in range(SLICES):
        unit *= 2.0**-SLICE_BITS
        sigma = 1.5 * 2.0**52 * unit  # adding and taking it away rounds to a multiple of unit, without error
        part = (rest + sigma) - sigma
        rest, low = two_sum(rest - part, low)
        out.append(part)
    return out


def outer_sum(d: np.ndarray, low: np.ndarray) -> Pair:
    """The sum over rows of outer products of d + low, for at most BLOCK rows, as a pair of matrices."""
    total = (np.zeros((d.shape[1],) * 2), np.zeros((d.shape[1],) * 2))
    parts = slices(d, low)
    for i, a in enumerate(parts):
        for j in range(i, min(len(parts), SLICES - i)):
            product = a.T @ parts[j]  # exact: integers under 2**51 in units of both slices
            for p in (product,) if i == j else (product, product.T):
                total = add(total, (p, np.zeros_like(p)))
    return total


def centred(x: np.ndarray, whole: np.ndarray, part: Pair) -> Pair:
    """x minus the mean, whole + part, as a pair; x and whole are integers under 2**53."""
    d, e = two_sum((x - whole).astype(float), -part[0])
    return two_sum(d, e - part[1])


def pair_of(values: list[Fraction]) -> Pair:
    high = np.array([float(v) for v in values])
    return high, np.array([float(v - Fraction(h)) for v, h in zip(values, high.tolist())])


# ---- eigenvectors -------------------------------------------------------------------------------------------------


def eigen(v: Pair) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix given as a pair.

    numpy's eigh reduces to a tridiagonal matrix and solves that by divide and conquer. Its vectors are then corrected
    to first order in extended precision against the whole pair; near-equal values keep their common space.
    """
    high, low = ((m + m.T) / 2 for m in v)
    values, vectors = np.linalg.eigh(high)
    wide = np.longdouble
    a, q = high.astype(wide) + low.astype(wide), vectors.astype(wide)
    gram = np.eye(len(a), dtype=wide) - q.T @ q
    image = q.T @ (a @ q)
    found = np.diag(image) / (1 - np.diag(gram))
    gap = found[None, :] - found[:, None]
    near = np.abs(gap) <= 1e-10 * np.abs(found).max(initial=0)
    step = np.where(near, gram / 2, (image + found[None, :] * gram) / np.where(near, 1, gap))
    q = q + q @ step
    q = q / np.sqrt((q * q).sum(axis=0))
    order = np.argsort(-found, kind="stable")
    return found[order].astype(float), q[:, order].astype(float)


# ---- Spark --------------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """n distinct vectors with integer sums; eigenvalues, eigenvectors as columns and the largest error of identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def mean(self) -> tuple[np.ndarray, Pair]:
        """The mean of each dimension as its floor and the rest."""
        parts = [divmod(s, max(self.n, 1)) for s in self.sums]
        return np.array([q for q, _ in parts], np.int64), pair_of([Fraction(r, max(self.n, 1)) for _, r in parts])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        d, low = centred(x, *self.mean())
        scale = np.where(self.values > 0, self.values, np.nan)
        return (d @ self.vectors + low @ self.vectors) / np.sqrt(scale)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2, exactly; None where that exceeds a long."""
        whole, _ = self.mean()
        rest = np.array([s - self.n * int(q) for s, q in zip(self.sums, whole)], np.int64)
        off = x - whole
        if self.n * (int(np.abs(off).max(initial=0)) + 1) >= 1 << 62:  # in Python's integers
            exact = [sum((self.n * int(o) - int(r)) ** 2 for o, r in zip(row, rest)) for row in off]
        else:
            t = np.abs(self.n * off - rest)
            a, b = t >> 31, t & (2**31 - 1)
            squares = [[int(v) for v in m] for m in (_exact_sum(a, a), _exact_sum(a, b), _exact_sum(b, b))]
            exact = [(p << 62) + (q << 32) + r for p, q, r in zip(*squares)]
        return [e if e < 1 << 63 else None for e in exact]


def _exact_sum(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Row sums of products of non-negative integers under 2**31: high and low halves are summed apart."""
    p = a * b
    return [(h << 32) + v for h, v in zip((p >> 32).sum(axis=1).tolist(), (p & 0xFFFFFFFF).sum(axis=1).tolist())]


def scaled(vector: str | Column = "embedding") -> Column:
    """floor(256 * c) of every entry as long; null where the vector is null or holds null or non-finite entries."""
    v = F.col(vector) if isinstance(vector, str) else vector
    entry = lambda c: c.cast("double")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(entry(c)) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda c: F.floor(entry(c) * SCALE).cast("long")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of an Arrow list column of longs as a matrix, without a Python object for an entry."""
    return np.asarray(column.flatten()).reshape(-1, dims)


def compensated_moments(rows: DataFrame, dims: int, make) -> tuple[Pair, Pair]:
    """(sum, sum of outer products) as pairs over the vectors that make()(x) gives, themselves pairs, dims of each.

    rows: one column x, an array of longs. A task returns one row of its pairs; FAN_IN of them meet in one task, and so
    on, until the driver may take what is left (FAN_IN of them for 64 dimensions, fewer for more), however many tasks
    there were.
    """
    width = dims * dims + dims
    schema = "high array<double>, low array<double>"

    def packed(total: Pair) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, width], t) for t in total], names=["high", "low"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, total = make(), (np.zeros(width), np.zeros(width))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.column(0).slice(start, BLOCK)
                d, low = turn(np.asarray(part.flatten()).reshape(len(part), -1))
                own = outer_sum(d, low)
                first = (np.zeros(dims), np.zeros(dims))
                for piece in slices(d, low):
                    first = add(first, (piece.sum(axis=0), np.zeros(dims)))
                total = add(total, tuple(np.concatenate([f, o.ravel()]) for f, o in zip(first, own)))
        yield from packed(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = (np.zeros(width), np.zeros(width))
        for batch in batches:
            for i in range(batch.num_rows):
                total = add(total, tuple(np.asarray(batch.column(k).slice(i, 1).flatten()) for k in (0, 1)))
        yield from packed(total)

    out, parts = rows.select("x").mapInArrow(sums, schema), rows.rdd.getNumPartitions()
    while parts > max(1, FAN_IN * 4096 // width):
        parts = -(-parts // FAN_IN)
        out = out.repartition(parts).mapInArrow(merge, schema)
    total = (np.zeros(width), np.zeros(width))
    for row in sorted(out.collect()):
        total = add(total, (np.array(row.high), np.array(row.low)))
    return tuple(t[:dims] for t in total), tuple(t[dims:].reshape(dims, dims) for t in total)


def covariance(rows: DataFrame, n: int, dims: int, make) -> Pair:
    """The covariance, divisor n, of the vectors that make()(x) gives about a centre that is theirs but for rounding."""
    first, second = compensated_moments(rows, dims, make)
    off = [Fraction(h) + Fraction(l) for h, l in zip(*map(np.ndarray.tolist, first))]
    exact = [(Fraction(h) + Fraction(l)) / n for h, l in zip(*(m.ravel().tolist() for m in second))]
    moved = [e - off[k // dims] * off[k % dims] / n**2 for k, e in enumerate(exact)]
    return tuple(m.reshape(dims, dims) for m in pair_of(moved))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors in column x (arrays of longs, no null); None without any.

    Vectors of the length that most distinct vectors have take part (of equally frequent ones the longest). Equal
    vectors meet in a grouping that drops copies before the shuffle, so a vector in a third of all rows is no hot key.
    Components whose eigenvalue is nothing but rounding (under dims * 2^-52 of the largest) get value 0 and no whitened
    figures.
    """
    spark = vectors.sparkSession
    once, path = common.stored(vectors.select("x").where(F.size("x") > 0).distinct(), "distinct-vectors")
    try:
        lengths = once.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
        if lengths is None:
            return None
        dims = lengths.dims
        once = once.where(F.size("x") == dims)
        exact = [F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")) for i in range(dims)]
        n, *sums = once.agg(F.count("*"), *exact).first()
        model = Whitening(n, [int(s) for s in sums], np.zeros(0), np.zeros((dims, 0)), np.zeros(0))
        centre = spark.sparkContext.broadcast(model.mean())
        v = covariance(once, n, dims, lambda: lambda x: centred(x, *centre.value))
        values, axes = eigen(v)
        k = min(components, dims)
        trace = float(np.trace(v[0]) + np.trace(v[1]))
        values = np.where(values > dims * 2.0**-52 * max(values[0], 0.0), values, 0.0)[:k]
        model = Whitening(n, model.sums, values, axes[:, :k], values / trace if trace > 0 else np.zeros(k))
        some = int((values > 0).sum())
        if some:
            fitted = spark.sparkContext.broadcast(Whitening(n, model.sums, values[:some], axes[:, :some], values[:some]))

            def make():
                own = fitted.value
                return lambda x: ((w := own.whitened(x)), np.zeros_like(w))

            error = covariance(once, n, some, make)[0] - np.eye(some)
            model.identity_error = float(np.abs(error).max())
        return model
    finally:
        common.remove(spark, path)


def whiten(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, of a rarer length than most, or holds null or non-finite entries are left out.
    Repeated rows repeat in the result but count once in the fit; a null vec_id stays null. deviation is null where it
    exceeds a long, whitened where a component has no variance (all vectors alike). An empty table, or one without a
    vector to fit, gives an empty table. Other columns are not read.
    """
    kind = dict(rows.dtypes)[vec_id]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = rows.select(F.col(vec_id).alias("vec_id"), scaled(vector).alias("x")).where("x is not null")
    model = fit(found.select("x"), components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    dims, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x, m = _matrix(part.column(1), dims), part.num_rows
                w = own.whitened(x)
                deviation = pa.array(own.deviations(x), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, own.n, np.int64)), deviation.take(each),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(own.explained, m)), pa.array(np.full(m * k, own.identity_error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return found.where(F.size("x") == dims).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding; nulls and non-finite vectors are left out, copies count once in the fit."""
    return whiten(common.table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_compensated_whitening": query}
