from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aislewise.llm import common, packing
from tests.compare import SMALLEST
from tests.llm.test_bpe import ODD

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(pieces, documents, window=packing.WINDOW):
    """documents: {doc_id: list of ids}. Every id in one piece, sequences gapless and within the window; returns padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == documents.keys()
    for doc, own in by_doc.items():
        ids, at = documents[doc], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_query_equals_brute_force(spark):
    documents = {r.doc_id: ids_of(r.text) for r in common.table(spark, SMALLEST, "documents").collect()}
    padding = check(packing.query(spark, SMALLEST).collect(), documents)
    assert padding <= 0.05 * sum(map(len, documents.values()))


def test_encoder_equals_the_library_for_every_character_and_for_very_long_matches():
    encode = packing.tokenizer_encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    points = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)} {chr(c)}1 {chr(c)}! {chr(c)}{chr(c)}x  {chr(c)}\n" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    texts += [" " * 300_000, "x" * 300_000, "ab" * 100_000, "!" * 200_000, "\n" * 200_000 + "a", "é" * 100_000, ""]
    ours = encode(texts)
    for text, ids, e in zip(texts, ours, TOKENIZER.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text[:20]


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (900, "Hello <|endoftext|> world"), (901, "<|endoftext|>")]
    documents = {i: ids_of(t) for i, t in rows}
    check(packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), documents)


def test_packer_for_any_order_of_sizes():
    rng = random.Random(2)
    for window in (1, 2, 7, 64):
        packer, filled, sizes = packing.Packer(window), defaultdict(int), []
        for _ in range(300):
            size = rng.choice([1, 1, 2, window, window + 1, 3 * window, rng.randint(1, 2 * window)])
            sizes.append(size)
            at = 0
            for start, length, number, offset in packer.add(size):
                assert start == at and offset == filled[number]
                filled[number] += length
                at += length
            assert at == size
            levels = np.bincount([f for f in filled.values() if f < window], minlength=window + 1)
            assert levels.tolist() == packer.count.tolist() == list(map(len, packer.windows))
        assert max(filled.values()) <= window and sum(filled.values()) == sum(sizes)


def test_a_hundred_thousand_open_windows():
    """Documents of which no two fit together: every window stays open, and later ones still fill them up."""
    packer = packing.Packer()
    opened = [p for _ in range(100_000) for p in packer.add(1500)]
    assert len({number for _, _, number, _ in opened}) == 100_000 == packer.count[1500]
    filled = [p for _ in range(100_000) for p in packer.add(548)]
    assert {offset for _, _, _, offset in filled} == {1500} and not packer.count.any()


def test_placement_minimises_the_sum_of_squares():
    rng = random.Random(5)
    packer = packing.Packer(32)
    for _ in range(400):
        size = rng.randint(1, 31)
        count = packer.count.copy()

        def after(level):
            then = count.copy()
            if level:
                then[level] -= 1
            if level + size < 32:
                then[level + size] += 1
            return int((then[1:32] ** 2).sum())

        choices = [lv for lv in range(0, 32 - size + 1) if lv == 0 or count[lv]]
        assert after(packer._level(size)) == min(map(after, choices))
        list(packer.add(size))


def test_nulls_repeated_rows_empty_tables_and_ids(spark):
    docs = spark.createDataFrame([(None, None, 1), (None, None, 1), (4, "a b", 2)], "doc_id long, text string, length int").coalesce(1)
    out = packing.pack_documents(docs, with_ids=True).collect()
    assert sorted((r.doc_id is None, r.length, r.doc_tokens) for r in out if r.doc_id is None) == [(True, 1, 1)] * 2
    own = sorted((r for r in out if r.doc_id == 4), key=lambda r: r.start)
    assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == ids_of("a b")
    assert packing.pack_documents(docs.limit(0)).count() == 0
