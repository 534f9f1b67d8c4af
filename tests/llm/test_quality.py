from __future__ import annotations

import random
import re

import numpy as np
import pytest

from aislewise.llm import common, quality
from tests.compare import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)} if len(set(windows)) < len(windows) else set()
    lines, seen, again = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 30, "a\n a\na\n\n\na", "#*$%&|<>#", "é\xa0é \x0b\x1c w", "l1\r\nl1\r\nl1", "a b c d e f a b c d e g h a b c d e", "日本 語 " * 9])
def test_base_counts(text):
    assert quality.statistics(text)[0] == plain_base(text)


def test_long_texts_count_like_short_ones(monkeypatch):
    rng = random.Random(1)
    for n in (0, 4, 5, 6, 200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(n)]
        short = quality.repeat_words(words)
        monkeypatch.setattr(quality, "_MANY", 0)
        assert quality.repeat_words(words) == short
        monkeypatch.undo()


def test_query(spark):
    truth = {r.doc_id: r.text for r in common.table(spark, SMALL, "documents").collect()}
    quality_of = {r.doc_id: r.quality for r in common.table(spark, SMALL, "labels").collect()}
    out = quality.query(spark, SMALL).collect()
    assert len(out) == len(truth)
    good = bad = good_lost = bad_lost = 0
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(truth[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
        if not r.base_failed and quality_of.get(r.doc_id) is not None:
            good += quality_of[r.doc_id] == 1
            bad += quality_of[r.doc_id] == 0
            good_lost += quality_of[r.doc_id] == 1 and not r.kept
            bad_lost += quality_of[r.doc_id] == 0 and not r.kept
    assert good_lost <= 0.02 * good and bad_lost >= 0.9 * bad > 0


def test_verdict_equals_a_plain_forest(spark):
    """kept, row by row, from trees walked one node at a time and a threshold found by trying every cut."""
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    model = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def score(text):
        row = quality.statistics(text)[1]
        return 2 ** (-sum(plain_path(t, row) for t in model.forest.trees) / len(model.forest.trees) / model.forest.norm)

    for r in quality.judge(docs.select("doc_id", "text"), model).collect():
        own = score(texts[r.doc_id])
        assert r.anomaly == pytest.approx(own)
        assert r.kept == (not r.base_failed and r.anomaly <= model.threshold)


def test_labels_set_the_threshold_only(spark):
    """The trees are the same whatever the labels say; the threshold is not."""
    rng = random.Random(12)
    text = lambda i: " ".join(f"{chr(97 + rng.randrange(26))}{'#' * (i % 5 == 0)}ord{chr(97 + k % 26)}" for k in range(30))
    docs = spark.createDataFrame([(i, text(i)) for i in range(200)], "doc_id long, text string")
    given = [quality.fit(docs, spark.createDataFrame([(i, q(i)) for i in range(200)], "doc_id long, quality int")) for q in (lambda i: int(i % 5 != 0), lambda i: 1)]
    for a, b in zip(given[0].forest.trees, given[1].forest.trees):
        assert all((x == y).all() for x, y in zip(a, b))
    assert given[0].threshold < float("inf") == given[1].threshold


def plain_path(tree, row):
    feature, value, child, path = tree
    node = 0
    while feature[node] >= 0:
        node = child[node] + (row[feature[node]] >= value[node])
    return path[node]


def test_forest_scores_by_path_length_and_finds_outliers():
    rng = np.random.default_rng(2)
    rows, far = rng.normal(size=(800, 4)), np.full((1, 4), 9.0)
    rows[:, 2] = 0  # the same in all ordinary rows
    forest = quality.fit_forest(rows, np.full(4, -9.0), np.full(4, 9.0), trees=50)
    some = np.concatenate([rows[:20], far])
    want = [2 ** (-np.mean([plain_path(t, r) for t in forest.trees]) / forest.norm) for r in some]
    assert forest.score(some) == pytest.approx(want)
    assert forest.score(far)[0] > forest.score(rows).max()


def test_forest_of_few_or_equal_rows():
    for rows in (np.zeros((0, 3)), np.zeros((1, 3)), np.ones((40, 3))):
        score = quality.fit_forest(rows, trees=3).score(np.zeros((2, 3)))
        assert len(score) == 2 and np.isfinite(score).all()


def test_calibration():
    scores, good = np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([True, True, True, False, False])
    assert 0.3 < quality.calibrate(scores, good) < 0.8
    assert quality.calibrate(scores, ~good) == float("inf")
    assert quality.calibrate(scores, np.ones(5, bool)) == float("inf")
    assert quality.calibrate(np.zeros(5), good) == float("inf")
    assert quality.calibrate(np.zeros(0), np.zeros(0, bool)) == float("inf")


def test_planted_symbol_soup_goes_and_prose_stays(spark):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}{c}" for a in "brtsl" for b in "aeiou" for c in "ndmk"]
    prose = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 300))) + ".") for i in range(400)]
    soup = [(1000 + i, " ".join(rng.choice(["###", "$$%", "|&|", "<>*", "AB#"]) + str(rng.random()) for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(prose + soup, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in prose[:200]] + [(i, 0) for i, _ in soup[:20]] + [(None, 0), (soup[0][0], 1), (99_999, 0)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.filter_documents(docs, labels).collect()}
    assert len(kept & {i for i, _ in prose}) >= 0.97 * len(prose)
    assert not kept & {i for i, _ in soup}


def test_nulls_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "a b", 2), (1, "a b", 2)], "doc_id long, text string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    out = quality.judge(docs, model)
    assert out.count() == 3 and not out.where("kept").count()
    assert quality.filter_documents(docs.limit(0), none).columns == docs.columns
    prose = "some plain words that follow each other in this short text of ours"
    own = spark.createDataFrame([(1, prose, "x", 7)], "doc_id long, text string, kept string, n_words int")
    assert quality.filter_documents(own, none).collect() == own.collect()
    assert quality.filter_documents(docs.limit(0), none).count() == 0


EXTREME = ["w " * 12 + "#" * 200_000 + " " + "!" * 200_000, "#" * 10_000 + " a" * 12, "7" * 300_000 + " a" * 12, "a" * 500_000 + " b" * 12, "\U00020000 " * 30_000, "A" * 1000 + "! ?" * 9]


@pytest.mark.parametrize("text", [None, "", "!", "#", "?" * 40, " " * 9, *EXTREME])
def test_features_are_shares(text):
    features = quality.statistics(text)[1]
    assert len(features) == quality.FEATURES and all(0 <= f <= 1 for f in features)


def test_an_extreme_document_changes_no_verdict_but_its_own(spark):
    docs, labels = common.table(spark, SMALL, "documents").select("doc_id", "text"), common.table(spark, SMALL, "labels")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(EXTREME)], "doc_id long, text string")
    verdicts = lambda rows: {r.doc_id: (r.kept, r.anomaly) for r in quality.judge(rows, quality.fit(rows, labels)).collect()}
    before, after = verdicts(docs), verdicts(docs.union(odd))
    assert {d: v for d, v in after.items() if d >= 0} == before and len(after) == len(before) + len(EXTREME)
    assert not after[-1][0] and not after[-2][0]


def test_held_out_rows_are_judged_as_well(spark):
    """A forest and threshold from four fifths of the labelled rows, held against the others."""
    texts = {r.doc_id: r.text for r in common.table(spark, SMALL, "documents").collect()}
    found = {r.doc_id: (quality.statistics(texts[r.doc_id]), r.quality == 1) for r in common.table(spark, SMALL, "labels").collect() if r.doc_id in texts}
    rows = [(f, good) for _, ((base, f), good) in sorted(found.items()) if not quality._base_failed(base)]
    fitted, held = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    forest = quality.fit_forest(np.array([f for f, _ in fitted]), np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    cut = quality.calibrate(forest.score(np.array([f for f, _ in fitted])), np.array([g for _, g in fitted]))
    gone = forest.score(np.array([f for f, _ in held])) > cut
    good = np.array([g for _, g in held])
    assert gone[~good].mean() >= 0.9 and gone[good].mean() <= 0.03


def test_unsampled_kinds_of_anomaly_are_split(spark):
    """Good and bad labelled rows have no '|'; splits from 0 to 1 reach the one table all the same."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "brtsl" for b in "aeiou" for c in "ndmk"]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(80))
    rows = [(i, text()) for i in range(6000)]
    before = quality.fit_forest
    seen = []
    try:
        quality.fit_forest = lambda rows, low=None, high=None, **more: seen.append((low, high)) or before(rows, low, high, **more)
        for at in (5, 1234, 5999):
            docs = spark.createDataFrame([(i, t.replace(" ", " | ") if i == at else t) for i, t in rows], "doc_id long, text string")
            labels = spark.createDataFrame([(i, 1) for i in range(100, 300)], "doc_id long, quality int")
            quality.fit(docs, labels)
    finally:
        quality.fit_forest = before
    assert all(high[0] > low[0] for low, high in seen) and len(seen) == 3


def test_a_repeated_doc_id_is_one_labelled_document(spark, monkeypatch):
    rows = [(i, " ".join(f"word{chr(97 + (i * k) % 26)}{chr(97 + k)}" for k in range(12 + i % 9))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 4 and 1) for i, _ in rows], "doc_id long, quality int")
    sizes, plain = [], quality.calibrate
    monkeypatch.setattr(quality, "calibrate", lambda scores, good: sizes.append(len(scores)) or plain(scores, good))
    for more in ([], [rows[0]] * 500):
        quality.fit(spark.createDataFrame(rows + more, "doc_id long, text string"), labels)
    assert sizes[0] == sizes[1] > 0
