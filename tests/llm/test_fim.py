from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from aislewise.llm import common, fim
from tests.compare import SMALL, SMALLEST, difference

#: Each grammar as a plain pattern that is matched from left to right.
PLAIN = {
    "words": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "lines": r"[^\n]*\n|[^\n]+",
    "characters": r"(?s:.)",
    "runs": r"[\x20\x09-\x0D]+|[0-9]+|[!-/:-@\[-`{-~]+|[^\x20\x09-\x0D0-9!-/:-@\[-`{-~]+",
}
ODD = ["", None, " ", "  a", "a  ", "a b\n\n c", "\n", "a\n\nb", " x  y", "\x1c a\x1d", "é \U0001f600\U0001f600 x\U0001d400y", "x<P>y z", "<S", "a <S>", "<<M>>", "12ab!?  3", "ab\x00 c", "  a", "]^[ -\\", "word " * 50_000, "x" * 300_000]


def plain_row(doc_id, text, units="words"):
    text = text or ""
    parts = re.findall(PLAIN[units], text)
    assert "".join(parts) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_query_equals_sql(spark):
    assert difference(fim.query(spark, SMALL), fim.SQL, SMALL) is None


def test_query_equals_brute_force(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = common.table(spark, SMALLEST, "documents").collect()
    rows = sorted(tuple(r) for r in fim.query(spark, SMALLEST).collect())
    assert rows == sorted((*(p := plain_row(d.doc_id, d.text))[:5], sha(p[5]), sha(p[6])) for d in docs)
    assert {r[2] for r in rows} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("units", sorted(PLAIN))
def test_every_grammar_on_odd_texts(spark, units):
    rows = [(i, t) for i in [*range(12), None] for t in ODD if len(t or "") < 1000 or (i or 0) < 3]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    out = fim.transform(docs, units).withColumn("again", fim.rebuilt(F.col("output"), F.col("form"))).drop("text").collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr(plain_row(i, t, units)) for i, t in rows)


def test_boundary_is_a_pattern_of_empty_places():
    assert fim.UNITS["words"].boundary() == r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    everything = fim.Grammar({}, frozenset({("rest", "rest")}))
    assert everything.boundary() == "(?!)"
    with pytest.raises(ValueError):
        fim.Grammar({"accent": "é"})
    with pytest.raises(ValueError):
        fim.Grammar({}, frozenset({("rest", "none")}))


def test_own_marks_columns_and_shares(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two "), "id").alias("text"), F.lit(7).alias("N"), F.lit("x").alias("row"), F.lit(1).alias("a.b"), F.lit(2).alias("units"), F.lit(3).alias("cut"))
    out = fim.transform(docs, fim_percent=100, spm_percent=0, marks=("[pre]", "[suf]", "[mid]"))
    assert out.columns == ["doc_id", "text", "row", "a.b", "units", "cut", *fim.ADDED]
    rows = out.withColumn("again", fim.rebuilt(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]"))).collect()
    assert all(r.form == "psm" and r.output.startswith("[pre]") and r.again == r.text and r["a.b"] == 1 and r.cut == 3 and r.n == 3 for r in rows)
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "x", "y"), ("abc", "b", "y"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.transform(docs, marks=marks)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a b c d")] * 3, "doc_id int, text string")
    assert fim.transform(docs).distinct().count() == 1 and fim.transform(docs).count() == 3
    assert fim.transform(docs.limit(0)).count() == 0


def test_no_shuffle_and_no_python(spark):
    plan = fim.query(spark, SMALLEST)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
