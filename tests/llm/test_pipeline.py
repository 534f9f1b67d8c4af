from __future__ import annotations

import corpus_pipeline
from aislewise.llm import bpe, common, langid, quality, queries, simhash
from tests.compare import SMALLEST
from tests.llm.test_langid import plain_predict
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_packing import check, ids_of
from tests.llm.test_quality import plain_base, plain_path
from tests.llm.test_radix_dedup import expected


def test_all_operators_are_registered():
    import __spark_entry__

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= __spark_entry__.queries().keys()
    assert queries.SQL.keys() <= queries.QUERIES.keys()
    assert bpe.QUERIES.keys() <= queries.QUERIES.keys()


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts and file.name not in ("corpus_pipeline.py", "__spark_entry__.py"):
            assert "aislewise.llm" not in file.read_text(), file


def test_stages_equal_brute_force(spark):
    """Each stage over what the one before has kept, against a plain version of its decision."""
    docs = common.table(spark, SMALLEST, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    labels = common.table(spark, SMALLEST, "labels")

    model = quality.fit(docs, labels)
    kept, _ = common.stored(stages["quality_rules"](spark, docs, SMALLEST), "t1")
    texts = {r.doc_id: r.text for r in docs.collect()}
    base = {d: plain_base(t) for d, t in texts.items()}
    failed = {d for d, b in base.items() if b[0] < 10 or 100 * b[4] > 20 * b[0]}
    trees, norm = model.forest.trees, model.forest.norm
    anomalous = {d for d, t in texts.items() if 2 ** (-sum(plain_path(tree, quality.statistics(t)[1]) for tree in trees) / len(trees) / norm) > model.threshold}
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == texts.keys() - failed - anomalous

    before = kept
    kept, _ = common.stored(stages["language_id"](spark, before, SMALLEST), "t2")
    dictionaries = langid.sample(before)
    want = {r.doc_id for r in before.collect() if (p := plain_predict(dictionaries, r.text))[0] != "und" and p[1] >= langid.MIN_MARGIN}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want
    assert len(want) >= 0.95 * before.count()

    before = kept
    kept, _ = common.stored(stages["exact_dedup"](spark, before, SMALLEST), "t3")
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {keep for _, keep, _, _ in expected([(r.doc_id, r.text) for r in before.collect()])}

    before = [(r.doc_id, r.text) for r in kept.collect()]
    kept, _ = common.stored(stages["near_dedup"](spark, kept, SMALLEST), "t4")
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == plain_kept(before)

    pieces = stages["packing"](spark, kept, SMALLEST).collect()
    check(pieces, {r.doc_id: ids_of(r.text) for r in kept.collect()})
    whole = corpus_pipeline.run(spark, SMALLEST).collect()
    assert sorted((p.doc_id, p.doc_tokens) for p in whole if p.start == 0) == sorted((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0)


def test_stages_of_an_empty_table(spark):
    docs = common.table(spark, SMALLEST, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALLEST).count() == 0


def test_one_document_of_each_near_group_stays(spark):
    assert simhash.MAX_BITS == 4
