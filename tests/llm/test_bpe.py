from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from aislewise.llm import bpe, common
from tests.compare import SMALLEST

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    None, "", " ", "   ", "\n\n  a", "a \n b", "don't 'll we'RE", "x" * 5000, "ab" * 4000, "é" * 300, "日本語 テスト", "a\xa0b \xa0 c", "  em space", "\x1c\x1d a\x1e b\x85 c", "tab\t\ttab \t x", "<|endoftext|> <|x|>",
    "123 4567 ١٢٣ ²", "👩‍👩‍👧 🏳️‍🌈", "é éx", "\r\n \r\n", "a" * 127 + " " + "b" * 129, "word, word. (word) -- 'word'", "​ zero​width", "﻿bom", "end ", " end  ",
]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def by_matrix(encoder, text):
    from aislewise.llm.segments import Remembering

    return np.frombuffer(next(Remembering(encoder.encode_later, encoder.encode_parts, "test").ids([text])), "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(encoder, text):
    ids = by_matrix(encoder, text)
    assert ids == ORACLE.encode_ordinary(text or "")
    assert encoder.decode(np.array(ids, "<u4").tobytes()) == (text or "").encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r\x0b\x0c\x1c\x85\xa0 　'sStTaAeéßǅ0٣²_-.,;!?#👍́‍")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(encoder, text):
    assert by_matrix(encoder, text) == ORACLE.encode_ordinary(text)


def test_rows_without_a_pair_and_long_matches(encoder):
    rng = random.Random(3)
    for n in (2, 3, 4, 5, 8, 9, 64, 65, 127, 128, 129, 400):
        for alphabet in ("ab", "qxz", "thein", "Жз"):
            word = "".join(rng.choice(alphabet) for _ in range(n))
            assert by_matrix(encoder, word) == ORACLE.encode_ordinary(word)


@pytest.mark.parametrize("word", ["thein" * 2000, "x" * 10_000, "".join(random.Random(1).choice("abcdefgh") for _ in range(10_000)), "Ж" * 5001])
def test_matches_of_ten_thousand_bytes(encoder, word):
    """Longer than the last bucket: many blocks, with pairs across their ends."""
    assert len(word.encode()) >= 10_000 and by_matrix(encoder, word) == ORACLE.encode_ordinary(word)


def test_rows_of_many_blocks_together(encoder):
    rng = random.Random(8)
    words = list({"".join(rng.choice("abcdefgthein") for _ in range(rng.randint(2, 700))).encode() for _ in range(800)})
    ids = encoder.encode_matches(words)
    assert all(np.frombuffer(ids[w], "<u4").tolist() == ORACLE.encode_ordinary(w.decode()) for w in words)


def test_every_code_point_has_the_librarys_class(encoder):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4000):
        text = "\n".join(f"{chr(c)}'s b{chr(c)}1" for c in points[i : i + 4000])
        matches = [m.encode() for m in encoder.split(text)]
        ids = encoder.encode_matches(list(set(matches)))
        assert np.frombuffer(b"".join(map(ids.__getitem__, matches)), "<u4").tolist() == ORACLE.encode_ordinary(text)


def test_query_equals_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in common.table(spark, SMALLEST, "documents").collect()}
    out = bpe.query(spark, SMALLEST).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = ORACLE.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_nulls_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 5, "a.b"), (1, None, 5, None), (None, "x y", 6, "c")], "doc_id long, text string, n_tokens int, `odd.name` string")
    out = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "odd.name", "n_tokens", "ids"]
    assert sorted(r.n_tokens for r in out.collect()) == [0, 0, 2]
    assert bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN, decode=True).count() == 0
