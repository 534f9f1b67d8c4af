from __future__ import annotations

import zlib

import pytest

from aislewise.llm import common, langid
from tests.compare import SMALL

WORDS = {
    "en": "the house and that with from they were this have which their would there about people water other time could",
    "de": "der und nicht eine werden über können zwischen jahre wurde durch haben gegen schon einen immer wieder deutsche",
    "fr": "les dans pour avec cette être nous vous elle leur était plus même aussi après toujours français depuis sans",
}


def train(spark):
    rows = [(i * 3 + k, " ".join(w.split()[j % 18] for j in range(i, i + 40)), lang) for i in range(40) for k, (lang, w) in enumerate(WORDS.items())]
    return langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in common.table(spark, SMALL, "documents").collect()}
    out = langid.query(spark, SMALL).collect()
    assert len(out) == len(truth)
    known = {r.lang for r in truth.values() if r.lang} | {langid.UNKNOWN}
    right = wrong = 0
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in known and 0 <= r.score <= 1
        assert (r.lang_pred == langid.UNKNOWN) == (not any(c.isalpha() for c in truth[r.doc_id].text or ""))
        if r.held_out and truth[r.doc_id].lang and r.lang_pred != langid.UNKNOWN:
            right += r.lang_pred == truth[r.doc_id].lang
            wrong += r.lang_pred != truth[r.doc_id].lang
    assert right / (right + wrong) >= 0.95


def plain_predict(dictionaries, text):
    """Language and margin with a compressor made anew for every text."""
    import zstandard

    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return "und", 0.0
    clean = f" {' '.join(words)} "
    sizes = {}
    for lang, own in dictionaries.items():
        data = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        maker = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False)
        sizes[lang] = sum(len(maker.compress(clean[i : i + langid.PIECE].encode())) for i in range(0, len(clean), langid.PIECE))
    best = min(sizes, key=lambda k: (sizes[k], k))
    return best, 1 - sizes[best] / min(s for k, s in sizes.items() if k != best)


def plain_sample(rows):
    """The dictionaries of (doc_id, text, lang) rows by Python loops; hashes are asked of Spark."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.active()
    hashes = spark.createDataFrame([(r[0],) for r in rows], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", F.lit("place")).alias("p")).distinct().collect()
    hashes = {r.doc_id: (r.h, r.p) for r in hashes}
    least = {}
    for doc_id, text, lang in rows:
        if lang is not None and text is not None:
            least[lang, doc_id] = min(text, least.get((lang, doc_id), text), key=lambda t: t.encode())
    out = {}
    for lang in {k[0] for k in least}:
        own, pieces = sorted((hashes[d][0] % (1 << 30), hashes[d][0], d, t) for (g, d), t in least.items() if g == lang)[: langid.MAX_DOCS], []
        for _, d, text in sorted(own_row[1:] for own_row in own):
            start = hashes[d][1] % (max(len(text) - langid.MAX_CHARS, 0) + 1)
            words = "".join(c if c.isalpha() else " " for c in text[start : start + langid.MAX_CHARS].lower()).split()
            if words and (piece := f" {' '.join(words)} ") not in pieces:
                pieces.append(piece)
        whole = b""
        for piece in pieces:
            if len(whole) + len(piece.encode()) > langid.DICT_BYTES:
                break
            whole += piece.encode()
        out[lang] = whole
    return out


def test_sample_equals_a_plain_one(spark):
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text", "lang")
    own = langid.sample(docs)
    assert own == plain_sample([tuple(r) for r in docs.collect()])
    assert all(len(d) > 20_000 and d.endswith(b" ") for d in own.values())


def test_thinning_does_not_overflow(spark):
    from pyspark.sql import functions as F

    rows = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    share = lambda ids: rows.where(langid._thinned(F.col("h"), F.lit(ids).cast("long"), 80)).count()
    assert share(20_000_000_000) == 0 and share(2**62) == 0 and share(100) == 200_000
    assert abs(share(3200) - 20_000) < 1000  # a tenth


def test_dictionaries_end_at_a_piece(monkeypatch):
    monkeypatch.setattr(langid, "DICT_BYTES", 10)
    assert langid._dictionary([" abc ", " \u00e9\u00e9\u00e9 ", " x "]) == b" abc "
    assert langid._dictionary([" abc ", " d ", " too long "]) == b" abc  d "


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    with pytest.raises(ValueError, match="over 2 languages"):
        train(spark)


def test_query_equals_a_plain_version(spark):
    import pyspark.sql.functions as F

    from tests.compare import SMALLEST

    docs = common.table(spark, SMALLEST, "documents")
    model = langid.sample(docs.where(~(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.query(spark, SMALLEST).collect():
        assert (r.lang_pred, r.score) == plain_predict(model, texts[r.doc_id])


@pytest.mark.parametrize("text", ["\xbd \xb2", "\u2460\u2461", "12_3 \u0663", "\u2160?"])
def test_numbers_are_no_letters(text):
    """Fractions, exponents and circled or Roman digits are numbers; only letters count."""
    assert langid.letters_only(text) == "" and langid.Classifier({"en": b" the "}).predict(text) == ("und", 0.0)


def test_letters_are_those_of_unicode():
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    wrong = [c for c in every if c.lower() == c and (langid.letters_only(c) != "") != c.isalpha()]
    assert not wrong


def test_the_stage_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "the house and that", 0.5, "x"), (2, "12", 0.5, "y")], "doc_id long, text string, score double, Accepted string")
    kept = langid.keep_clear(docs, train(spark))
    assert kept.columns == docs.columns and kept.collect() == docs.where("doc_id = 1").collect()


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, f"word{i} text", "xx") for i in range(40)], "doc_id long, text string, lang string")
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    import pyspark.sql.functions as F

    model = langid.sample(docs.where(~(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)))
    assert set(model) == {"xx"} and 0 < len(kept) < 40


def test_narrow_margins_are_rejected(spark):
    model = langid.Classifier(train(spark))
    assert model.predict("the people have water and there would be time")[0] == "en"
    lang, margin = model.predict("zzz")
    assert lang in WORDS and margin < 0.2
    docs = spark.createDataFrame([(1, "werden nicht können"), (2, "123 ..."), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in langid.classify(docs, train(spark), min_margin=0.01).collect()}
    assert out[1].lang_pred == "de" and out[1].accepted
    assert all(out[i].lang_pred == "und" and out[i].score == 0 and not out[i].accepted for i in (2, 3, 4))
    assert not langid.classify(docs, train(spark), min_margin=1.1).where("accepted").count()


def test_whole_texts_are_read(spark):
    """The language of the many words at the end counts, not that of the first ones."""
    model = langid.Classifier(train(spark))
    assert model.predict("the house and that " + f" {WORDS['fr']}" * 3000)[0] == "fr"


def test_a_very_long_text_goes_through_the_stage(spark):
    docs = spark.createDataFrame([(1, f" {WORDS['de']}" * 20_000)], "doc_id long, text string")
    assert langid.classify(docs, train(spark)).first().lang_pred == "de"


def test_ties_take_the_first_name():
    model = langid.Classifier({"b": b" same words ", "a": b" same words "})
    assert model.predict("same words") == ("a", 0.0)


def test_without_labels_and_with_one_language(spark):
    docs = spark.createDataFrame([(1, "a b c", None)], "doc_id long, text string, lang string")
    assert langid.sample(docs) == {}
    assert langid.classify(docs, {}).first().lang_pred == "und"
    assert langid.Classifier({"en": b" the "}).predict("x") == ("en", 1.0)


@pytest.mark.parametrize("name", ["lang_pred", "SCORE", "accepted", "odd.name", "c0"])
def test_clashing_names_and_empty_tables(spark, name):
    docs = spark.createDataFrame([(1, "the house", 5)], f"doc_id long, text string, `{name}` int")
    out = langid.classify(docs, {"en": b" the house "})
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.count() == 1
    assert langid.classify(docs.limit(0), {"en": b" the "}).count() == 0


def test_every_language_is_learned(spark):
    """Rare languages beyond the 64 most frequent have dictionaries too."""
    rows = [(i, f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} text", f"l{i % 90:02d}") for i in range(900)] + [(9_999, "once only", "rare")]
    assert set(langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == {f"l{i:02d}" for i in range(90)} | {"rare"}


def test_a_shared_opening_is_not_all_that_is_learned(spark):
    opening = "all rights reserved by the owner of this page " * 20
    rows = [(i * 3 + k, opening + f"{w} " * 40, lang) for i in range(40) for k, (lang, w) in enumerate(WORDS.items())]
    model = langid.Classifier(langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    for lang, words in WORDS.items():
        found, margin = model.predict(" ".join(words.split()[::2]))
        assert found == lang and margin >= langid.MIN_MARGIN


def test_a_repeated_doc_id_is_one_document(spark):
    """Copies of one id take one place of the sample, whatever its hash."""
    rows = [(i, f"only {''.join(chr(97 + int(c)) for c in str(i))} here", "xx") for i in range(20)]
    want = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=10)
    for i in range(20):
        again = spark.createDataFrame(rows + [rows[i]] * 50 + [(i, "zz later text", "xx")] * 50, "doc_id long, text string, lang string")
        assert langid.sample(again, max_docs=10) == want
