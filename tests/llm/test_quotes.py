from __future__ import annotations

import hashlib
import random
import re

import pytest

from aislewise.llm import common, quotes
from tests.compare import SMALLEST


def norm(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ")


def parse(body):
    """Runs (depth, text) of a body."""
    runs = []
    for line in re.sub(r"\r\n?", "\n", body or "").split("\n"):
        mark = re.match(r"(?:>[ \t]?)+", line)
        depth, words = (mark.group().count(">"), line[mark.end() :]) if mark else (0, line)
        if runs and runs[-1][0] == depth:
            runs[-1] = depth, runs[-1][1] + "\n" + words
        else:
            runs.append((depth, words))
    return runs


def plain_links(rows):
    """The expected output of link_quotes for (thread, message, body), messages unique and not null."""
    wrote, out, parents = {}, {}, {}
    units = {}
    for thread, message, body in rows:
        own = units[thread, message] = [(d, True, norm(t)) for d, t in parse(body)] + [(d, False, norm(x)) for d, t in parse(body) if "\n" in t for x in t.split("\n")]
        for depth, _, text in own:
            if depth == 0 and text:
                wrote[thread, text] = min(message, wrote.get((thread, text), message))
    for thread, message, body in rows:
        quoted = [(d, whole, wrote.get((thread, t))) for d, whole, t in units[thread, message] if d and t]
        quoted = [(d, whole, o if o is not None and o < message else None) for d, whole, o in quoted]
        ones = [[o for d, w, o in quoted if d == 1 and o is not None and w >= least] for least in (1, 0)]
        parents[thread, message] = max(ones[0]) if ones[0] else max(ones[1], default=None)
        clean = "\n".join(t for d, t in parse(body) if d == 0).strip(" ")
        out[thread, message] = [sum(w for _, w, _ in quoted), sum(w and o is not None for _, w, o in quoted), clean]
    for (thread, message), own in out.items():
        root, depth = message, 0
        while parents[thread, root] is not None:
            root, depth = parents[thread, root], depth + 1
        own[:0] = [parents[thread, message], root, depth]
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    return {(r.thread, r.message): (r.parent, r.root, r.reply_depth, r.n_passages, r.n_linked, r.clean_text) for r in df.collect()}


def check(spark, rows):
    assert found(quotes.link_quotes(spark.createDataFrame(rows, "thread long, message long, body string"))) == plain_links(rows)


def test_query_equals_brute_force(spark):
    mail = [(r.conv_id, r.turn, r.body) for r in quotes.as_mail(common.table(spark, SMALLEST, "conversations")).collect()]
    keys = [m[:2] for m in mail]
    mail = [m for m in mail if keys.count(m[:2]) == 1]
    want = plain_links(mail)
    got = {(r.conv_id, r.turn): r for r in quotes.query(spark, SMALLEST).collect()}
    same = 0
    for key, (parent, root, depth, passages, linked, clean) in want.items():
        r = got[key]
        assert r.clean_sha256 == hashlib.sha256(clean.encode()).hexdigest()
        assert (r.n_passages, r.n_linked, r.parent_turn, r.root_turn, r.reply_depth) == (passages, linked, parent, root, depth)
        same += 1
    assert same == len(mail) > 0


def test_nested_levels_wrapped_lines_and_unknown_quotes(spark):
    check(spark, [
        (1, 1, "Hello all,\nshall we meet?"),
        (1, 2, "> Hello ALL,\n>   shall we meet?\nYes, at noon."),
        (1, 3, "> > Hello all,\n> > shall we meet?\n> Yes, at noon.\nFine."),
        (1, 4, "> shall we meet?\nWhere?"),
        (1, 5, ">> Yes, at noon.\n>never written\nHm."),
        (1, 6, "> > >   \n>\n\nempty quotes"),
        (2, 1, "> Hello all,\n> shall we meet?\nanother thread"),
        (2, 2, "> a later text\nquotes what comes later"),
        (2, 3, "a later text"),
        (3, 1, None), (3, 2, ""), (3, 3, "\r\n> \r\n"), (4, 1, "same"), (4, 2, "same"), (4, 3, "> same\nreply to the first"), (4, 4, ">same\n> same\nmore"),
    ])


def test_random_threads(spark):
    rng = random.Random(8)
    rows = []
    for thread in range(12):
        said = []
        for message in range(25):
            lines = []
            for _ in range(rng.randint(0, 4)):
                depth = rng.randint(0, 3)
                text = rng.choice(said) if said and rng.random() < 0.7 else f"Text {rng.randint(0, 30)}  of\t{thread % 3}"
                lines += [">" * depth + " " * bool(depth) + x for x in text.split("\n")]
            own = f"own {message}" + rng.choice(["", "\nsecond line"])
            said.append(own)
            rows.append((thread, message, "\n".join([*lines, own])))
    check(spark, rows)


def test_reply_order(spark):
    """Sorted by thread, first message, depth and message; partitions follow each other."""
    rows = [(t, i, f"> m{i // 2}\nm{i}" if i > 1 else f"m{i}") for t in (2, 1) for i in range(9, 0, -1)]
    linked = quotes.link_quotes(spark.createDataFrame(rows, "thread long, message long, body string"))
    got = [(r.thread, r.root, r.reply_depth, r.message) for r in quotes.reply_ordered(linked).collect()]
    assert got == sorted(got) and got[:4] == [(1, 1, 0, 1), (1, 1, 1, 2), (1, 1, 1, 3), (1, 1, 2, 4)]


def test_quotes_that_texts_hold_themselves(spark):
    talk = [("c", 0, "The plan is set."), ("c", 1, "Which plan?"), ("c", 2, "> The plan is set.\nI mean this one."), ("d", 0, "> The plan is set.\nNo such thing here.")]
    mail = quotes.as_mail(spark.createDataFrame(talk, "conv_id string, turn long, text string"))
    want = plain_links([(r.conv_id, r.turn, r.body) for r in mail.collect()])
    assert found(quotes.link_quotes(mail, "conv_id", "turn", "body")) == want
    assert want["c", 2][:2] == (1, 0) and want["c", 2][3:5] == (2, 1)
    own = quotes.link_quotes(spark.createDataFrame(talk, "conv_id string, turn long, text string"), "conv_id", "turn", "text")
    assert found(own)["c", 2] == (0, 0, 1, 1, 1, "I mean this one.") and found(own)["d", 0][3:5] == (1, 0)


def test_a_very_long_message(spark):
    body = "\n".join(f"{'>' * (i % 4)}line {i // 3}" for i in range(30_000))
    check(spark, [(1, 1, "line 3\nline 4"), (1, 2, body)])


def test_copies_with_other_bodies(spark):
    """Rows of one message with different bodies: each has its own passages, and all share the links."""
    rows = [(1, 1, "first"), (1, 2, "second"), (1, 3, "> first\na"), (1, 3, "> second\nb"), (1, 3, "> second\nb")]
    out = quotes.link_quotes(spark.createDataFrame(rows, "thread long, message long, body string")).where("message = 3").collect()
    assert len(out) == 3 and {(r.parent, r.n_passages, r.n_linked) for r in out} == {(2, 3, 3)} and sorted(r.clean_text for r in out) == ["a", "b", "b"]


def test_long_reply_chain(spark):
    rows = [(1, 0, "m0")] + [(1, i, f"> m{i - 1}\nm{i}") for i in range(1, 150)]
    out = found(quotes.link_quotes(spark.createDataFrame(rows, "thread long, message long, body string")))
    assert out[1, 149][:3] == (148, 0, 149)


def test_null_threads_null_messages_copies_and_other_columns(spark):
    rows = [(None, 1, "first", 1), (None, 2, "> first\nsecond", 2), (None, 2, "> first\nsecond", 2), (0, 1, "> first\nelsewhere", 3), (5, None, "> first\nx", 4)]
    out = quotes.link_quotes(spark.createDataFrame(rows, "thread long, message long, body string, parent int"))
    got = sorted(((r.thread, r.message, r.parent, r.root, r.reply_depth) for r in out.collect()), key=repr)
    assert got == sorted([(None, 1, None, 1, 0), (None, 2, 1, 1, 1), (None, 2, 1, 1, 1), (0, 1, None, 1, 0), (5, None, None, None, 0)], key=repr)


def test_empty_table(spark):
    assert quotes.link_quotes(spark.createDataFrame([], "thread long, message long, body string")).count() == 0


@pytest.mark.parametrize("operator", ["mapInPandas", "mapInArrow", "applyInPandas", "pandas_udf", ".rdd", "udf("])
def test_main_path_is_native(operator):
    from pathlib import Path

    assert operator not in Path(quotes.__file__).read_text()
