from __future__ import annotations

import random

import corpus_pipeline
import pytest

from aislewise.llm import common, near_copies
from tests.compare import SMALL


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    label, sets = {d: d for d, _ in rows}, {d: plain_shingles(t) for d, t in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d for d in ids if label[d] == d}


def corpus():
    """Copies with some words replaced, in pairs and in one large group; most lie between 0.7 and 0.95."""
    rng, rows = random.Random(5), []
    word = lambda: f"w{rng.randint(0, 5000)}"
    for size in [2] * 40 + [90]:
        base = [word() for _ in range(300)]
        for _ in range(size):
            own = list(base)
            for at in rng.sample(range(300), rng.randint(1, 9)):
                own[at] = word()
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, None), (901, " "), (902, "short text"), (903, "Short  text"), (904, "short texts")]


@pytest.mark.parametrize("block", [8, 512])
def test_stage_finds_pairs_of_eight_tenths(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([*rows, rows[0], (None, rows[0][1])], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert got.count(None) == 1 and got.count(0) == 2
    assert set(got) - {None} == plain_kept(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.one_of_each_group(docs).count() == 0


def test_very_long_texts_and_clashing_names(spark):
    """Copies of 60,000 words with few changes, and columns called as the stage's own."""
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(60_000)]
    near, far = list(words), list(words)
    for at in rng.sample(range(60_000), 500):  # five shingles each: similarity 0.92
        near[at] = "x"
    for at in rng.sample(range(60_000), 5000):  # 0.42
        far[at] = "y"
    rows = [(1, " ".join(words), 1, "a", 0.5, 7, 8), (2, " ".join(near), 2, "b", 0.5, 7, 8), (3, " ".join(far), 3, "c", 0.5, 7, 8), (4, "one " * 90_000, 4, "d", 0.5, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FP long, root string, `bands.x` double, component_id int, n int")
    kept = near_copies.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((r.doc_id, r.FP, r.root, r["bands.x"], r.component_id, r.n) for r in kept.collect()) == [(1, 1, "a", 0.5, 7, 8), (3, 3, "c", 0.5, 7, 8), (4, 4, "d", 0.5, 7, 8)]


def test_recall_over_all_documents(spark):
    """Every pair of the table's documents at 0.8 or more is found, and no other document goes."""
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    sets = sorted(((d, plain_shingles(t)) for d, t in map(tuple, docs.collect())), key=lambda r: len(r[1]))
    label = {d: d for d, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, own) in enumerate(sets):
        for b, other in sets[i + 1 :]:
            if 5 * len(own) < 4 * len(other):
                break
            shared = len(own & other)
            if 5 * shared >= 4 * (len(own) + len(other) - shared):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in near_copies.one_of_each_group(docs).collect()}
    assert kept == {d for d in label if label[d] == d} and len(kept) < len(label)
