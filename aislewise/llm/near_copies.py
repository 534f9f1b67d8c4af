"""SimHash near duplicates, completed to all documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

Candidates are the links of the Gray-order index over 5-word fingerprints. Fingerprints within its radius hold a part of
the pairs at 0.8 only, and a radius that held them all would compare everything with everything, so MinHash bands add
those beyond it. Every link is then checked on whole shingle sets. Documents that share a band or a fingerprint are linked
to the first of them only, so links never grow with the square of a group. A candidate group that these
checked links leave in pieces is compared again: all documents outside its largest piece with all of the group, dealt
out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components, join_counted

WORDS, SIMILAR = 5, 0.8
#: A pair shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9993 at s = 0.8, more above.
BANDS, ROWS, SEED = 24, 6, 42
#: Documents of a group, and as many of those outside its largest piece, that are compared at a time.
BLOCK = 512
_CHUNK = 1 << 12
_RNG = np.random.default_rng(SEED)
_TIMES, _PLUS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1), _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all shingles; words as in simhash.fingerprint(), a shorter text is one shingle."""
    return np.unique(simhash.shingle_hashes(simhash.words_of(text), WORDS, SEED))


def bands(own: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), _CHUNK):
        least = np.minimum(least, (own[i : i + _CHUNK] * _TIMES + _PLUS).min(axis=1))
    return [_signed(least[k * ROWS : (k + 1) * ROWS], k) for k in range(BANDS)]


def _signed(values: np.ndarray, seed: int = SEED) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), seed)).view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            words = simhash.words_of(text.as_py())
            every = simhash.shingle_hashes(words, WORDS, SEED)
            own = np.unique(every)
            rows.append((_signed(own), int(np.uint64(simhash.majority_bits(every) if words else 0).view(np.int64)), bands(own)))
        fp, sim, band = zip(*rows) if rows else ([], [], [])
        columns = [batch.column(0), pa.array(fp, pa.int64()), pa.array(sim, pa.int64()), pa.array(band, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "sim", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, own) of rows (fp, text) whose text has that fp."""
    for batch in batches:
        for start in range(0, batch.num_rows, common.ROWS_AT_ONCE):
            part = batch.slice(start, common.ROWS_AT_ONCE)
            own = [(fp, s) for fp, s in zip(part.column(0).to_pylist(), (shingles(t.as_py()) for t in part.column(1))) if _signed(s) == fp]
            yield pa.RecordBatch.from_arrays([pa.array([fp for fp, _ in own], pa.int64()), pa.array([s.view(np.int64) for _, s in own], pa.list_(pa.int64()))], names=["fp", "own"])


def _similar(shared, a, b):
    return shared >= SIMILAR * (a + b - shared) - 1e-9


def _compared(rows: pa.Table) -> pa.Table:
    """Links that connect all similar pairs of a probe with another document of the block."""
    fp, own = rows["fp"].to_numpy(), [np.asarray(s, np.int64) for s in rows["own"].to_numpy()]
    probe = rows["probe"].to_numpy()
    built, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
    sizes = np.array([len(s) for s in own])
    owner = np.repeat(np.arange(len(built)), sizes[built])
    values = np.concatenate([own[i] for i in built]) if len(built) else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in probes:
        low, high = np.searchsorted(values, own[p], "left"), np.searchsorted(values, own[p], "right")
        n = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(built))
        near = built[_similar(shared, sizes[p], sizes[built]) & (fp[built] != fp[p])]
        left.append(np.full(len(near), fp[p])), right.append(fp[near])
    ids, ends = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    i, j = simhash.forest(ends[: len(ends) // 2], ends[len(ends) // 2 :])
    return pa.table({"a": pa.array(ids[i], pa.int64()), "b": pa.array(ids[j], pa.int64())})


def _rest(cls: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the pieces (v) of each candidate group (root)."""
    pieces = cls.groupBy("root", "v").agg(F.count("*").alias("n"))
    groups = pieces.groupBy("root").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.max_by("v", F.struct("n", "v")).alias("most"), F.max("n").alias("largest")).where("k > 1")
    rows, _ = common.stored(sets.join(cls, "fp").join(groups, "root").select("root", "fp", "own", (F.col("v") != F.col("most")).alias("probe"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("largest")) / BLOCK).cast("int").alias("probe_blocks")), "near-rest")
    dealt = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int").alias(n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n)
    built = rows.select("root", dealt("blocks"), every("probe_blocks"), "fp", "own", F.lit(False).alias("probe"))
    probes = rows.where("probe").select("root", every("blocks"), dealt("probe_blocks"), "fp", "own", "probe")
    return built.union(probes).groupBy("root", "blocks", "probe_blocks").applyInArrow(_compared, "a long, b long")


def near_links(sketches: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) between fps that connect all similar candidates; sketches: doc_id, fp, sim, bands."""
    once = sketches.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("sim").alias("sim"), F.first("bands").alias("bands"))
    once, _ = common.stored(once, "near-distinct")
    banded = once.select("fp", F.explode("bands").alias("band"))
    first = banded.groupBy("band").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    by_band = join_counted(banded, first, "band", "n").where("fp <> a").select("a", F.col("fp").alias("b"))
    sims, _ = common.stored(once.groupBy("sim").agg(F.min("fp").alias("a"), F.count("*").alias("n")), "near-sims")
    by_sim = join_counted(once, sims.where("n > 1"), "sim", "n").where("fp <> a").select("a", F.col("fp").alias("b"))
    near = simhash.hamming_links(sims.select(F.col("sim").alias("fp")))
    end = lambda name: sims.select(F.col("sim").alias(name), F.col("a").alias(f"{name}_fp"))
    by_index = near.join(end("a"), "a").join(end("b"), "b").select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b"))
    stars, _ = common.stored(by_band.union(by_sim).union(by_index).distinct(), "near-stars")
    roots, _ = common.stored(components(stars), "near-groups")
    member = once.select("fp", "least").join(roots.select(F.col("node").alias("fp")), "fp")
    texts = docs.select(F.col(doc_id).alias("least"), F.col(text).alias("text")).join(member, "least").select("fp", "text")
    sets, _ = common.stored(texts.mapInArrow(_sets, "fp long, own array<long>").dropDuplicates(["fp"]), "near-sets")
    side = lambda name: sets.select(F.col("fp").alias(name), F.col("own").alias(f"{name}_own"))
    shared: Column = F.size(F.array_intersect("a_own", "b_own"))
    pairs = stars.join(side("a"), "a").join(side("b"), "b").where(_similar(shared, F.size("a_own"), F.size("b_own")))
    links, _ = common.stored(pairs.select("a", "b"), "near-links")
    pieces, _ = common.stored(components(links), "near-pieces")
    cls = roots.join(pieces.select("node", F.col("root").alias("v")), "node", "left").select(F.col("node").alias("fp"), "root", F.coalesce("v", "node").alias("v"))
    return links.union(_rest(cls, sets))


def one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs without those that chains of similar documents join to a smaller doc_id; all columns stay.

    Rows with a null doc_id stay and join nothing. Null, empty and blank texts are alike. Rows that share the smallest
    doc_id of a group stay together.
    """
    named = docs.where(F.col(doc_id).isNotNull())
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    plain = named.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketches, _ = common.stored(plain.mapInArrow(_sketches, f"doc_id {kind}, fp long, sim long, bands array<long>"), "near-sketches")
    found = simhash.labelled(sketches.select("doc_id", "fp"), links=near_links(sketches, named, doc_id, text))
    return simhash.without(docs, found.where("doc_id <> component_id"), doc_id)
