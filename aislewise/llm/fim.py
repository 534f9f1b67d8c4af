"""Fill-in-middle transformation: texts cut at zero-width boundaries, their pieces put into prefix, suffix, middle order.

A unit grammar says which characters may stand side by side inside one unit. It is translated to one regular expression
of look-arounds that matches the empty place between two characters of different units, so Spark's own split cuts a text
there and keeps every character.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
#: The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
REST = "rest"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Grammar:
    """Units by neighbouring characters.

    classes: the inside of a regular expression's bracket by class name, ASCII characters only, no two classes alike in
    any; every other character is of the class `rest`. joined: (left, right) pairs of classes that stay in one unit
    where they meet; between any other two neighbours a unit ends.
    """

    classes: Mapping[str, str]
    joined: frozenset[tuple[str, str]] = field(default_factory=frozenset)

    def __post_init__(self):
        if REST in self.classes or not all(c.isascii() for c in self.classes.values()):
            raise ValueError("classes are sets of ASCII characters; what they leave is the class rest")
        unknown = {name for pair in self.joined for name in pair} - {*self.classes, REST}
        if unknown:
            raise ValueError(f"unknown classes {sorted(unknown)}")

    def bracket(self, names: Iterable[str]) -> str:
        """The bracket that any character of the named classes matches."""
        names = set(names)
        if REST not in names:
            return f"[{''.join(self.classes[n] for n in self.classes if n in names)}]"
        outside = "".join(own for n, own in self.classes.items() if n not in names)
        return f"[^{outside}]" if outside else r"[\x00-\x{10FFFF}]"

    def boundary(self) -> str:
        """A pattern of the empty places between units: for each left class, a look-behind and the right classes it ends at.

        Left classes with the same right ones share an alternative. Neither the start nor the end of a text matches.
        """
        names = [*self.classes, REST]
        ends_at: dict[tuple[str, ...], list[str]] = {}
        for left in names:
            ends_at.setdefault(tuple(r for r in names if (left, r) not in self.joined), []).append(left)
        return "|".join(f"(?<={self.bracket(left)})(?={self.bracket(right)})" for right, left in ends_at.items() if right) or r"(?!)"


def _pairs(*pairs: str) -> frozenset[tuple[str, str]]:
    return frozenset(tuple(p.split("-")) for p in pairs)


#: Grammars by name. words: white space and the word after it, white space at the end alone. lines: with their line feed.
UNITS = {
    "words": Grammar({"space": r"\x20\x09-\x0D"}, _pairs("space-space", "space-rest", "rest-rest")),
    "lines": Grammar({"feed": r"\x0A"}, _pairs("rest-rest", "rest-feed")),
    "characters": Grammar({}),
    "runs": Grammar({"space": r"\x20\x09-\x0D", "digit": r"0-9", "sign": r"!-/:-@\[-`{-~"}, _pairs("space-space", "digit-digit", "sign-sign", "rest-rest")),
}


def pieces(text: Column, grammar: Grammar) -> Column:
    """The units of text in order, joined they are the text; an empty text has none, null counts as empty."""
    text = common.or_empty(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def _draw(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def rebuilt(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, found from output and form alone."""
    part = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    first, second, middle = (F.get(part, F.lit(i)) for i in (1, 2, 3))  # plain outputs may hold marks: they stay as they are
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def _check(marks: tuple[str, str, str]) -> None:
    """Marks must be found again in any output: none within another, and no end of one the beginning of one."""
    inside = any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j)
    overlap = any(a.startswith(b[i:]) for a in marks for b in marks for i in range(1, len(b)))
    if len(marks) != 3 or not all(marks) or inside or overlap:
        raise ValueError("three marks that do not overlap are needed")


def transform(
    docs: DataFrame, units: str | Grammar = "words", text: str = "text", doc_id: str = "doc_id", seed: int = SEED,
    fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """docs (all columns) with n, form, prefix_chars, middle_chars and output.

    The places of both cuts and the form come from SHA-256 of seed and doc_id, so a row gives the same output on every
    run and in every task, and rows of one doc_id are cut by the same draws; a null doc_id draws as the empty one. A text
    is plain (its own output, lengths null) if it is null or empty, if it holds a mark, or by its draw. Prefix, middle
    or suffix may be empty. Columns of docs named like an added one are replaced. An empty table stays empty.
    """
    _check(marks)
    grammar = UNITS[units] if isinstance(units, str) else units
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in ADDED]
    own, p, s, m = F.col("text"), *map(F.lit, marks)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.struct(*kept).alias("row"), common.or_empty(text).alias("text"), digest.alias("digest"))
    rows = rows.withColumn("units", pieces(own, grammar)).withColumn("n", F.size("units").cast("long"))
    first, second = ((_draw(F.col("digest"), k) % (F.col("n") + 1)).cast("int") for k in (0, 1))
    plain = (own == "") | F.contains(own, p) | F.contains(own, s) | F.contains(own, m) | (_draw(F.col("digest"), 2) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "a": F.least(first, second), "b": F.greatest(first, second)})

    def joined(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("units", start, length), "")

    a, b = F.col("a"), F.col("b")
    cut = F.struct(joined(F.lit(1), a).alias("prefix"), joined(a + 1, b - a).alias("middle"), joined(b + 1, F.size("units")).alias("suffix"))
    rows = rows.withColumn("cut", F.when(F.col("form") != "plain", cut))
    prefix, middle, suffix = (F.col(f"cut.{k}") for k in ("prefix", "middle", "suffix"))
    output = F.when(F.col("form") == "plain", own).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    lengths = [F.char_length(c).cast("long").alias(f"{k}_chars") for k, c in (("prefix", prefix), ("middle", middle))]
    return rows.select("row", "n", "form", *lengths, output.alias("output")).select("row.*", *ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, form, cut lengths and digests of output and rebuilt text of every document; null texts count as empty."""
    out = transform(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(c, 256).alias(f"{k}_sha256") for k, c in (("output", F.col("output")), ("restored", rebuilt(F.col("output"), F.col("form"))))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
h AS (SELECT doc_id, text, units, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
    ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT doc_id, text, n, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, units FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
    array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
QUERIES = {"op11_lookaround_fim": query}
