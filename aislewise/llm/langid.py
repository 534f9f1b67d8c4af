"""Language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Bounds of the training sample of each language: documents, characters of a document and bytes of the dictionary. With
#: letters of one byte all MAX_DOCS pieces fit; of other scripts whole pieces as far as they fit.
MAX_DOCS, MAX_CHARS, DICT_BYTES = 80, 400, 32 << 10
#: Distinct labels of languages up to which a sample is taken; more are an error, as dictionaries go to every task.
MAX_LANGS = 8192
#: Characters that one frame holds: every part of a text, however long, meets the dictionary.
PIECE = 8192
#: How many times MAX_DOCS ids of a language are ranked.
THINNED = 4
#: One level for texts of every length.
LEVEL = 11
#: Margin (share of the second-smallest size) below which a text is rejected.
MIN_MARGIN = 0.004
UNKNOWN = "und"


_WORDS = re.compile(r"[^\W\d_]+").findall


@lru_cache(1)
def _other_numbers() -> dict[str, str]:
    """Numbers that the pattern of words lets pass though they are no letters, such as fractions, and a space for each."""
    return {c: " " for c in map(chr, range(0x80, 0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha()}


def letters_only(text: str | None) -> str:
    """Lower-case letter runs, one space between them and around them: what languages are told apart by."""
    text = (text or "").lower()
    if not text.isascii() and not (numbers := _other_numbers()).keys().isdisjoint(text):
        text = text.translate(str.maketrans(numbers))
    words = _WORDS(text)
    return f" {' '.join(words)} " if words else ""


def sample(docs: DataFrame, max_docs: int = MAX_DOCS) -> dict[str, bytes]:
    """A bounded dictionary text for every language of labelled rows (doc_id, text, lang), at most max_docs for each.

    Rows with null lang, null text or null doc_id are not learned from. Documents are chosen by a hash of doc_id, and
    ids alone are ranked, so texts of the chosen rows only reach the driver: MAX_CHARS of each, from a place in the
    whole text that a hash of doc_id chooses. However often a doc_id repeats, it is one document, with its least text.
    A language's ids are thinned by their hash to about THINNED times max_docs before they are ranked, so no task gets
    all ids of a language. A dictionary holds whole pieces, in order of the hash, until the next would not fit into
    DICT_BYTES. Over MAX_LANGS languages are a ValueError, so what is broadcast and collected is bounded.
    """
    labelled = docs.where("lang is not null and text is not null and doc_id is not null")
    found = labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    many = F.broadcast(docs.sparkSession.createDataFrame(found, "lang string, ids long"))
    place = F.xxhash64("doc_id")
    ids = labelled.select("doc_id", "lang").join(many, "lang").where(_thinned(place, F.col("ids"), max_docs)).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.pmod(place, F.lit(1 << 30)), place, "doc_id")  # as ids are thinned
    ids = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_docs).select("doc_id", "lang")
    start = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - MAX_CHARS, F.lit(0)) + 1) + 1
    chosen = labelled.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = chosen.select("lang", F.xxhash64("doc_id").alias("h"), F.col("text").substr(start.cast("int"), F.lit(MAX_CHARS)).alias("text")).collect()
    texts: dict[str, dict[str, None]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.h, r.text)):
        texts.setdefault(row.lang, {}).setdefault(letters_only(row.text))
    return {lang: own for lang, pieces in texts.items() if (own := _dictionary(pieces))}


def _thinned(place: Column, ids: Column, max_docs: int) -> Column:
    """Whether a hash is among the share of a language's ids that is ranked; in doubles, so that no count overflows."""
    return F.pmod(place, F.lit(1 << 30)) < float((1 << 30) * THINNED * max_docs) / ids.cast("double")


def _dictionary(pieces: Iterable[str]) -> bytes:
    """Whole pieces in order, up to the first that DICT_BYTES has no room for."""
    out = b""
    for piece in pieces:
        own = piece.encode("utf-8", "surrogatepass")
        if len(out) + len(own) > DICT_BYTES:
            break
        out += own
    return out


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False, write_checksum=False)


class Classifier:
    """Compressors by language; sizes() sums the frames of all pieces of a text."""

    def __init__(self, dictionaries: Mapping[str, bytes]):
        self.langs = sorted(dictionaries)
        self.compressors = [_compressor(dictionaries[lang], LEVEL) for lang in self.langs]

    def sizes(self, text: str) -> list[int]:
        pieces = [text[i : i + PIECE].encode("utf-8", "surrogatepass") for i in range(0, len(text), PIECE)]
        return [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin from 0 to 1); UNKNOWN and 0 for a text without a letter, or without a learned language."""
        clean = letters_only(text)
        if not clean or not self.langs:
            return UNKNOWN, 0.0
        sizes = self.sizes(clean)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], self.langs[k]))
        rest = [s for k, s in enumerate(sizes) if k != best]
        return self.langs[best], (1 - sizes[best] / min(rest)) if rest else 1.0


def classify(docs: DataFrame, dictionaries: Mapping[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs (all columns) with lang_pred, score (the margin) and accepted.

    accepted is false for a text without letters (lang_pred `und`, score 0) and for margins under min_margin; a text
    whose sizes tie takes the first language by name. Whole texts are encoded, in pieces. Columns of docs with those
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(dictionaries))

    def make():
        model = Classifier(shared.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [model.predict(t.as_py()) for t in texts]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x != UNKNOWN and s >= min_margin for x, s in found], pa.bool_())]

        return work

    return common.with_arrow_columns(docs, ["text"], "lang_pred string, score double, accepted boolean", make)


def keep_clear(docs: DataFrame, dictionaries: Mapping[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs that classify() accepts, with their own columns, whatever these are called."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(dictionaries))

    def make():
        model = Classifier(shared.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            found = [model.predict(t.as_py()) for t in texts]
            return [pa.array([x != UNKNOWN and s >= min_margin for x, s in found], pa.bool_())]

        return work

    return common.where_arrow(docs, ["text"], make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out; null texts are `und`, repeated rows repeat."""
    docs = common.table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = sample(docs.where(~held_out))
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op3_compression_langid": query}
