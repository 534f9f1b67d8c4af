from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from aislewise.llm import common, components, simhash
from tests.compare import SMALLEST


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    digests = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests))


def plain_labels(rows, max_bits=4):
    """{row index: component_id} by comparing all pairs; rows: (doc_id, fingerprint)."""
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= max_bits:
                label[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {k: min((d for d in own if d is not None), default=None) for k, own in groups.items()}
    return [least[find(i)] for i in range(len(rows))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One TWO", "a b c", "a b c d", "A b\x0bc\td  e", "a\xa0b c d e f", "É é Ä ß ñ a b", "x " * 5000, "w\x00 \x1f y z q"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_query_equals_all_pairs(spark):
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in common.table(spark, SMALLEST, "documents").collect()]
    want = {d: (f"{fp:016x}", c) for (d, fp), c in zip(docs, plain_labels(docs))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, SMALLEST).collect()} == want


def crowded(rng, n, base, bits):
    out = set()
    while len(out) < n:
        fp = base
        for b in rng.sample(range(64), rng.randint(0, bits)):
            fp ^= 1 << b
        out.add(fp)
    return sorted(out)


def groups_of(values, links):
    label = {f: f for f in values}

    def find(f):
        while label[f] != f:
            f = label[f]
        return f

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    out = {}
    for f in values:
        out.setdefault(find(f), set()).add(f)
    return sorted(map(sorted, out.values()))


def signed(fps):
    return [f - (1 << 64) if f >> 63 else f for f in fps]


def links_by_pairs(fps, max_bits=4):
    own = np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(own[:, None] ^ own[None, :]) <= max_bits)
    return [(fps[a], fps[b]) for a, b in zip(i, j) if a < b]


@pytest.mark.parametrize("node,row", [(16, 4), (64, 16), (simhash.NODE, simhash.ROW)])
def test_links_of_crowded_fingerprints(spark, node, row):
    """Groups that lie close together, over many nodes of the index and over one."""
    rng = random.Random(node)
    fps = sorted({*crowded(rng, 300, 0, 7), *crowded(rng, 150, 0xFFFF_0000_FFFF_0000, 9), *[rng.getrandbits(64) for _ in range(100)]})
    links = simhash.hamming_links(spark.createDataFrame([(f,) for f in signed(fps)], "fp long"), node=node, row=row).collect()
    want = [tuple(signed(p)) for p in links_by_pairs(fps)]
    assert groups_of(signed(fps), [(r.a, r.b) for r in links]) == groups_of(signed(fps), want)


def test_index_finds_every_link_of_a_larger_table(spark):
    """All documents of sf0.1: the index over several nodes against all pairs."""
    from tests.compare import TESTDATA

    fps = simhash.fingerprints(common.table(spark, str(TESTDATA / "sf0.1"), "documents")).select("fp").distinct()
    fps, _ = common.stored(fps, "t-fps")
    values = sorted(r.fp for r in fps.collect())
    own = np.array(values, np.int64).view(np.uint64)
    want = []
    for i in range(len(own)):
        near = np.flatnonzero(np.bitwise_count(own[i + 1 :] ^ own[i]) <= 4) + i + 1
        want += [(values[i], values[j]) for j in near]
    links = [(r.a, r.b) for r in simhash.hamming_links(fps, node=1 << 10, row=1 << 7).collect()]
    assert len(values) > 9000 and want and groups_of(values, links) == groups_of(values, want)


def test_query_equals_all_pairs_at_a_hundredth(spark):
    from tests.compare import SMALL

    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in common.table(spark, SMALL, "documents").collect()]
    want = {d: (f"{fp:016x}", c) for (d, fp), c in zip(docs, plain_labels(docs))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, SMALL).collect()} == want


def gray_sorted(values):
    fp = np.array(sorted(values), np.uint64)
    return fp[np.argsort(simhash.gray_rank(fp))]


def test_search_finds_every_pair():
    rng = random.Random(9)
    for n in (1, 2, 17, 130, 700):
        fp = gray_sorted(crowded(rng, n, rng.getrandbits(64), 8))
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
        found = [(int(i), int(j)) for a, b in simhash.search(fp) for i, j in zip(a, b)]
        assert sorted(found) == [(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near))) if i < j]
        for cut in {n // 3, n // 2} - {0}:
            found = [(int(i), int(j)) for a, b in simhash.search(fp[:cut], fp[cut:]) for i, j in zip(a, b)]
            assert sorted(found) == [(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near[:cut, cut:])))]


def test_spanning_links_have_the_components_of_all_pairs():
    rng = random.Random(10)
    for n in (1, 5, 60, 500):
        values = crowded(rng, n, rng.getrandbits(64), 9)
        fp = gray_sorted(values)
        for other in (None, fp[n // 2 :]):
            own = fp if other is None else fp[: n // 2]
            if not len(own):
                continue
            a, b = simhash.spanning_links(own, other)
            want = links_by_pairs(values) if other is None else [p for p in links_by_pairs(values) if (p[0] in own) != (p[1] in own)]
            assert len(a) <= n and groups_of(values, zip(a.tolist(), b.tolist())) == groups_of(values, want)


def test_gray_rank_orders_the_reflected_code():
    code = np.arange(64, dtype=np.uint64)
    assert (simhash.gray_rank(code ^ (code >> np.uint64(1))) == code).all()


def test_gray_order_sorts_like_the_rank(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(200)]
    rows = spark.createDataFrame([(f,) for f in signed(fps)], "fp long").orderBy(simhash.gray_order(F.col("fp"))).collect()
    assert np.array([r.fp for r in rows]).view(np.uint64).tolist() == gray_sorted(fps).tolist()


def test_nulls_copies_other_columns_and_empty_tables(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(5, text, 1), (3, text, 2), (3, text, 2), (None, text, 3), (8, None, 4), (9, "", 5), (None, "  ", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert out == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (8, 8), (9, 8), (None, 8)], key=repr)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 3, None, 8, None], key=repr)
    clash = docs.withColumnRenamed("fp", "near_copy")
    assert simhash.one_of_each_group(clash).columns == clash.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(100)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(200)] + [(7, 7), (None, 1), (1, 0), (1, 0)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    assert found == {x: find(x) for x in label}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 5)
    rows = spark.createDataFrame([(k, i) for k in range(6) for i in range(k * 3)] + [(None, 1)], "k long, i long")
    totals = rows.groupBy("k").count()
    got = sorted((r.k, r.i, r["count"]) for r in components.join_counted(rows, totals, "k", "count").collect())
    assert got == sorted((k, i, 3 * k) for k in range(6) for i in range(k * 3))
    star = spark.createDataFrame([(i, 5000) for i in range(300)] + [(5000, 5001)], "a long, b long")
    assert {r.root for r in components.components(star).collect()} == {0}
