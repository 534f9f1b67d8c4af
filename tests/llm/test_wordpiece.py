from __future__ import annotations

import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from aislewise.llm import common, wordpiece
from tests.compare import SMALLEST


def greedy(word, first, later):
    """Pieces of greedy longest match, 0 for a word that cannot be spelled."""
    at, n = 0, 0
    while at < len(word):
        pieces = later if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), max_size=12), st.lists(st.text("abc", min_size=1, max_size=5), max_size=12), st.lists(st.text("abcd", max_size=14), min_size=1, max_size=8))
def test_counts_equal_greedy_longest_match(first, later, words):
    automaton = wordpiece.Automaton([p.encode() for p in first] + [b"##" + p.encode() for p in later])
    one_set = wordpiece.Automaton([p.encode() for p in first], b"")
    for word in words:
        assert automaton.count(word.encode()) == greedy(word, set(first), set(later))
        assert one_set.count(word.encode()) == greedy(word, set(first), set(first))


def test_long_words_take_linear_time():
    automaton = wordpiece.Automaton([b"a" * n for n in range(1, 60)], b"")
    assert automaton.count(b"a" * 1_000_000) == -(-1_000_000 // 59)
    assert automaton.count(b"a" * 500_000 + b"b") == 0


def test_query_equals_greedy_longest_match(spark):
    pieces = set(wordpiece.byte_level_pieces(public_tokenizers.path("byte_bpe_50k.json")))
    longest = max(map(len, pieces))

    def count(word):
        at, n = 0, 0
        while at < len(word):
            at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces)
            n += 1
        return n

    texts = {r.doc_id: r.text or "" for r in common.table(spark, SMALLEST, "documents").collect()}
    out = wordpiece.query(spark, SMALLEST).collect()
    assert len(out) == len(texts)
    known = {}
    for r in out:
        words = texts[r.doc_id].encode().split()
        for w in set(words) - known.keys():
            known[w] = count(b" " + w)
        assert (r.n_words, r.n_pieces, r.n_unknown) == (len(words), sum(known[w] for w in words), 0)


def test_nulls_other_columns_and_empty_tables(spark):
    rng = random.Random(0)
    long = "".join(rng.choice("ab") for _ in range(200_000))
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, " ab \x0b zz ", 3), (4, long, 3), (4, long, 3)], "doc_id long, text string, N_WORDS int")
    out = wordpiece.count_pieces(docs, [b" a", b" ab", b"a", b"b", b" "], b"")
    rows = sorted((r.doc_id, r.n_words, r.n_pieces, r.n_unknown) for r in out.collect())
    assert rows[:3] == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 2, 2, 1)] and rows[3] == rows[4]
    assert wordpiece.count_pieces(docs.limit(0), [b"a"], b"").count() == 0
    assert wordpiece.count_pieces(docs, [], b"").where("doc_id = 3").first().n_unknown == 2
