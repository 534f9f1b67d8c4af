from __future__ import annotations

import hashlib
import random
import re

import pytest

from aislewise.llm import radix_dedup
from tests.compare import SMALLEST, difference


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


def test_equals_sql(spark):
    assert difference(radix_dedup.query(spark, SMALLEST), radix_dedup.SQL, SMALLEST) is None


def test_texts_that_part_at_every_depth(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ab") for _ in range(70_000))
    rows = [(i, base[: rng.choice([0, 1, 63, 64, 65, 128, 1023, 1024, 1025, 1088, 17_000, 17_472, 70_000])] + rng.choice(["", "x", " ", "\t\n "])) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\x0b"), (204, "\xa0"), (205, "é" * 50), (206, "é" * 50 + "e"), (207, "é" * 50)]
    assert found(radix_dedup.dedup_exact(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_null_ids_repeated_rows_and_other_columns(spark):
    rows = [(None, "a"), (None, "a"), (3, "b"), (3, "b"), (None, "b"), (1, "c")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, kept string, group_size int")
    out = radix_dedup.dedup_exact(docs)
    assert found(out) == expected(rows)
    assert out.where("kept").count() == 3
    survivors = radix_dedup.drop_exact_duplicates(docs)
    assert survivors.columns == docs.columns and survivors.count() == 3


@pytest.mark.parametrize("clash", ["norm", "rid", "rest", "row", "chunk", "gid"])
def test_clashing_names(spark, clash):
    docs = spark.createDataFrame([(1, "a", 5), (2, "a", 6)], f"doc_id long, text string, `{clash}` int")
    assert [tuple(r) for r in radix_dedup.drop_exact_duplicates(docs).collect()] == [(1, "a", 5)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert radix_dedup.dedup_exact(docs).count() == 0
    assert radix_dedup.drop_exact_duplicates(docs).count() == 0


def test_rows_of_files_are_told_apart_by_their_place(spark, tmp_path):
    """Repeated rows in several files: one stays, however the files are dealt to tasks in each job."""
    rows = [(1, "same text", i) for i in range(6)] + [(2, "same text", 9), (3, "other", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rid = radix_dedup._row_id(docs)
    assert docs.select(rid.alias("r")).distinct().count() == 8
    kept = radix_dedup.drop_exact_duplicates(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
    out = radix_dedup.dedup_exact(docs.select("doc_id", "text")).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in out) == sorted([(1, 1, True), *[(1, 1, False)] * 5, (2, 1, False), (3, 3, True)])
