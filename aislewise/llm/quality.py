"""Quality rules: an isolation forest over rule statistics, its threshold calibrated on labelled rows."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
NGRAM = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Bound of what the driver fits on: labelled rows for trees and threshold.
LABELLED_ROWS = 16_384
TREES, TREE_ROWS, SEED = 200, 256, 7
#: Height limit: the mean height of a tree over TREE_ROWS rows.
DEPTH = 8
#: Largest share of labelled good rows that the threshold may reject.
MAX_GOOD_LOSS = 0.02
#: Words from which repeats are counted with arrays instead of tuples.
_MANY = 20_000

FEATURES = 6
#: Characters a word at which the feature of word lengths is a half.
WORD_CHARS = 6
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


# ---- rule statistics ----------------------------------------------------------------------------------------------


def repeat_words(words: list[bytes], size: int = NGRAM) -> int:
    """Words inside windows of `size` words that are found twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    if len(words) < _MANY:
        windows = list(zip(*[words[i:] for i in range(size)]))
        counts = Counter(windows)
        if len(counts) == n:
            return 0
        again = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    else:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        code = ids[:n]
        for i in range(1, size):  # exact: pairs of numbers are numbered anew after each word
            _, code = np.unique(code * len(numbers) + ids[i : i + n], return_inverse=True)
        again = np.bincount(code)[code] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + size, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(base counts in the order of BASE, the forest's features) of a whole text; null counts as empty.

    Each feature is a share from 0 to 1 of a text of any length and content, so no text widens the range in which the
    forest splits. Repeats are no feature: the base rules judge them, and clean texts that repeat a line are rare but good.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n, chars = len(words), len(text) - sum(map(text.count, common.ASCII_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(common.ASCII_SPACE)]
    duplicates, repeats = len(lines) - len(set(lines)), repeat_words(words)
    letters = upper = digits = 0
    for c, k in Counter(text).items():
        letters += k * c.isalpha()
        upper += k * c.isupper()
        digits += k * c.isdigit()
    marks = sum(map(text.count, "!?"))
    features = (
        symbols / max(symbols + n, 1),
        upper / max(letters, 1),
        letters / max(len(text), 1),
        marks / max(marks + n, 1),
        chars / max(chars + WORD_CHARS * n, 1),
        digits / max(chars, 1),
    )
    return (n, chars, symbols, duplicates, repeats), features


# ---- isolation forest ---------------------------------------------------------------------------------------------


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at leaves), value, left child (right: the next), path length at leaves."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    norm: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Near 1 for rows that few random splits isolate, under 0.5 for ordinary ones."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, value, child, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[at_row, np.maximum(f, 0)] >= value[node]
                node = np.where(inner, child[node] + right, node)
            total += path[node]
        return 2.0 ** (-total / max(len(self.trees), 1) / self.norm)


def fit_forest(rows: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """Trees over samples of rows. Splits fall anywhere between low and high (default: the rows' own range).

    So a feature that is the same in all sampled rows is split as well, and a row with another value there is alone
    after few splits.
    """
    rng, out = np.random.default_rng(seed), []
    size = min(tree_rows, len(rows))
    low, high = (rows.min(axis=0), rows.max(axis=0)) if low is None and size else (low, high)
    for _ in range(trees if size else 0):
        feature, value, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows[rng.choice(len(rows), size, replace=False)], low, high, 0)]
        while todo:
            node, own, least, most, level = todo.pop()
            spread = np.flatnonzero(most > least)
            if level >= depth or len(own) <= 1 or not len(spread):
                path[node] = level + float(_mean_path(len(own)))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(least[f], most[f]))
            cut = cut if cut > least[f] else most[f]
            feature[node], value[node], child[node] = f, cut, len(feature)
            below, above = most.copy(), least.copy()
            below[f] = above[f] = cut
            for part, a, b in ((own[own[:, f] < cut], least, below), (own[own[:, f] >= cut], above, most)):
                todo.append((len(feature), part, a, b, level + 1))
                feature.append(-1), value.append(0.0), child.append(0), path.append(0.0)
        out.append(tuple(np.array(x) for x in (feature, value, child, path)))
    return Forest(out, max(float(_mean_path(size)), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, max_good_loss: float = MAX_GOOD_LOSS) -> float:
    """The threshold over which rows go: best true minus false rate among those that lose few good rows.

    Of thresholds that are equally good the middle one. Infinite (nothing goes) without both kinds of labels.
    """
    if not good.any() or good.all():
        return float("inf")
    cuts = np.unique(scores)
    mids = (cuts[1:] + cuts[:-1]) / 2
    bad_sorted, good_sorted = np.sort(scores[~good]), np.sort(scores[good])
    caught = 1 - np.searchsorted(bad_sorted, mids, "right") / len(bad_sorted)
    lost = 1 - np.searchsorted(good_sorted, mids, "right") / len(good_sorted)
    gain = np.where(lost <= max_good_loss, caught - lost, -1.0)
    if not len(mids) or gain.max() <= 0:
        return float("inf")
    best = mids[gain == gain.max()]
    return float(best[0] + best[-1]) / 2


# ---- Spark --------------------------------------------------------------------------------------------------------


@dataclass
class QualityModel:
    forest: Forest
    threshold: float


def _base_failed(base: tuple[int, ...]) -> bool:
    return base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]


def _verdicts(model: QualityModel, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, anomaly, kept) of what statistics() gave for some texts."""
    failed = np.array([_base_failed(b) for b, _ in found], bool)
    score = model.forest.score(np.array([f for _, f in found], float).reshape(-1, FEATURES))
    return failed, score, ~failed & (score <= model.threshold)


def _measured(docs: DataFrame) -> DataFrame:
    """docs with failed and features of each whole text, the text left out."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            found = [statistics(t.as_py()) for t in texts]
            return [pa.array([_base_failed(b) for b, _ in found], pa.bool_()), pa.array([f for _, f in found], pa.list_(pa.float64()))]

        return work

    return common.with_arrow_columns(docs, ["text"], "failed boolean, features array<double>", make).where("not failed").drop("text", "failed")


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fits on LABELLED_ROWS labelled documents, chosen by a hash of doc_id; splits fall anywhere from 0 to 1.

    So a feature that all of them have alike is split as well, and no document, labelled or not, shifts the splits of
    the others: an extreme row changes no verdict but its own.

    labels: doc_id, quality (0 or 1; several rows of one document count as its lowest, nulls are left out). Only rows
    that pass the base rules take part. Good and bad alike give the trees, which don't know the labels; these set the
    threshold only, and without labels nothing is anomalous. Rows of one doc_id are one document, with its least text.
    Texts stay on executors; the driver gets features.
    """
    chosen = F.xxhash64("doc_id")
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(chosen, "doc_id").limit(LABELLED_ROWS)
    once = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = _measured(once.select("text", "quality")).select("quality", "features").collect()
    found.sort(key=lambda r: r.features)  # the same model whatever order tasks end in
    known = np.array([r.features for r in found], float).reshape(-1, FEATURES)
    forest = fit_forest(known, np.zeros(FEATURES), np.ones(FEATURES))
    return QualityModel(forest, calibrate(forest.score(known), np.array([r.quality == 1 for r in found], bool)))


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs (all columns) with the base counts, base_failed, anomaly (the forest's score) and kept.

    Null and empty texts have no words and fail the base rules. kept is false for base failures and for anomalies over
    the model's threshold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [statistics(t.as_py()) for t in texts]
            counts = [pa.array(c, pa.int64()) for c in (zip(*[b for b, _ in found]) if found else [[]] * 5)]
            return [*counts, *map(pa.array, _verdicts(own, found))]

        return work

    added = ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, anomaly double, kept boolean"
    return common.with_arrow_columns(docs, ["text"], added, make)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, fitted on the same rows, with their own columns, whatever these are called.

    Null and empty texts go; repeated rows stay or go together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def make():
        own = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(_verdicts(own, [statistics(t.as_py()) for t in texts])[2])]

        return work

    return common.where_arrow(docs, ["text"], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base_failed, kept and anomaly of every document; nulls and empty texts fail, repeated rows repeat."""
    docs = common.table(spark, sf_dir, "documents")
    out = judge(docs.select("doc_id", "text"), fit(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", *BASE, "base_failed", "kept", "anomaly")


QUERIES = {"op8_isolation_quality": query}
