from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aislewise.llm import common, pattern_packing
from tests.compare import SMALL, SMALLEST
from tests.llm.test_bpe import ODD

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text, end=pattern_packing.END_ID):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def check(pieces, documents, window=pattern_packing.WINDOW):
    """documents: {doc_id: ids}. Cuts, digests and places as the contract asks; returns the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == documents.keys()
    for doc, own in by_doc.items():
        ids, at = documents[doc], 0
        for k, p in enumerate(sorted(own, key=lambda p: p.piece)):
            assert p.piece == k and p.start == at and (p.length == window or k == 0)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids) and (len(own) == 1 or len(ids) > window)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(by_sequence)


def first_fit_decreasing(lengths, window):
    free = []
    for size in sorted(lengths, reverse=True):
        for i, f in enumerate(free):
            if f >= size:
                free[i] -= size
                break
        else:
            free.append(window - size)
    return len(free)


@pytest.mark.parametrize("folder", [SMALLEST, SMALL])
def test_query_equals_brute_force(spark, folder):
    documents = {r.doc_id: ids_of(r.text) for r in common.table(spark, folder, "documents").collect()}
    found = check(pattern_packing.query(spark, folder).collect(), documents)
    window = pattern_packing.WINDOW
    lengths = [n for ids in documents.values() for n in [window] * (len(ids) // window) + [len(ids) % window] if n]
    assert -(-sum(lengths) // window) <= found <= first_fit_decreasing(lengths, window)


def test_odd_texts_copies_nulls_and_other_columns(spark):
    texts = [*ODD, "", None, "word " * 9000, "x" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("length", F.lit("a")).withColumn("Task", F.lit(1)).repartition(5)
    check(pattern_packing.pack(docs).collect(), {i: ids_of(t) for i, t in enumerate(texts)})
    again = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (None, None)], "doc_id long, text string")
    rows = pattern_packing.pack(again).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == {(None, 3): 1, (3, 3): 2, (None, 1): 1}
    assert len({r.sequence_id for r in rows}) == 1
    ends = [0, *(r.offset + r.length for r in sorted(rows, key=lambda r: r.offset))]
    assert sorted(r.offset for r in rows) == ends[:-1] and ends[-1] == 10
    assert pattern_packing.pack(again.limit(0)).count() == 0


def test_one_length_in_many_tasks_and_whole_sequences(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("")).otherwise(F.repeat(F.lit("a b "), (F.col("id") % 40).cast("int"))).alias("text")).repartition(30)
    packed = pattern_packing.pack(docs, window=64, with_ids=True).cache()
    documents = {r.doc_id: ids_of(r.text) for r in docs.collect()}
    rows = packed.collect()
    check(rows, documents, 64)
    whole = {r.sequence_id: r for r in pattern_packing.sequences(packed).collect()}
    for p in rows:
        ids = np.frombuffer(whole[p.sequence_id].ids, "<u4")
        assert len(ids) == whole[p.sequence_id].length
        assert ids[p.offset : p.offset + p.length].tolist() == documents[p.doc_id][p.start : p.start + p.length]


def used(plan, window):
    counts = np.zeros(window + 1, np.int64)
    for lengths, repeats in plan:
        assert sum(lengths) <= window and repeats > 0
        for v in lengths:
            counts[v] += repeats
    return counts


@pytest.mark.parametrize("seed", range(20))
def test_plan_uses_every_length_as_often_as_counted(seed):
    rng = np.random.default_rng(seed)
    window = int(rng.integers(2, 300))
    counts = rng.integers(0, [2, 5, 1000, 10**12][seed % 4], window + 1) * (rng.random(window + 1) < [0.05, 0.5, 1][seed % 3])
    counts[0] = 0
    plan = pattern_packing.plan(counts)
    assert (used(plan, window) == counts).all()
    if counts.sum() < 3000:
        lengths = [v for v, n in enumerate(counts) for _ in range(int(n))]
        assert sum(n for _, n in plan) <= first_fit_decreasing(lengths, window) + 1
    where = pattern_packing.places(plan, counts)
    if counts.sum() < 10**6:
        length = np.repeat(np.arange(window + 1), counts)
        rank = np.concatenate([np.arange(n) for n in counts])
        sequence, offset = where.of(length, rank)
        assert len(set(zip(sequence.tolist(), offset.tolist()))) == len(length)


def test_patterns_are_all_partitions_of_the_window_into_three():
    for window in (1, 2, 3, 12, 37):
        found = sorted(map(tuple, pattern_packing.patterns(np.ones(window + 1, int)).tolist()))
        assert found == sorted((a, b, c) for a in range(1, window) for b in range(1, a + 1) for c in range(0, b + 1) if a + b + c == window)
    assert len(pattern_packing.patterns(np.zeros(9, int))) == 0


def test_fit_finds_exact_repeats():
    """A histogram made of patterns is fitted to less than a thousandth, and the plan leaves next to no padding."""
    rng = np.random.default_rng(4)
    every = pattern_packing.patterns(np.ones(129, int))
    true = rng.integers(0, 200, len(every)) * (rng.random(len(every)) < 0.3)
    counts = sum(np.bincount(every[:, k], true, 129) for k in range(3)).astype(np.int64)
    counts[0] = 0
    x = pattern_packing.fit_repeats(every, counts)
    got = sum(np.bincount(every[:, k], x, 129) for k in range(3))
    assert (x >= 0).all() and np.abs((got - counts)[1:] * np.arange(1, 129)).sum() < 1e-3 * (counts * np.arange(129)).sum()
    plan = pattern_packing.plan(counts)
    assert sum(n for _, n in plan) <= 1.002 * true.sum()


def test_large_window_takes_pairs(spark):
    counts = np.zeros(5001, np.int64)
    counts[[1, 2000, 3000, 5000]] = [3, 7, 7, 2]
    assert sum(n for _, n in pattern_packing.plan(counts)) == 10
