"""Chat formatting by quotation linking, in DataFrame operations only.

Quoted passages (runs of lines of one quote depth) and their single lines are normalised and hashed, and joined to the
earliest earlier message of the thread that wrote them. The quoted message becomes the parent; roots and reply depths
follow by doubling pointers, and what a message wrote itself is its text without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

_QUOTE = r"^((?:>[ \t]?)+)"


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed: quoting programs re-wrap and indent."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _lines(body: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(body, F.lit("")), r"\r\n?", "\n"), "\n", -1)


def _units(messages: DataFrame) -> DataFrame:
    """(_t, _n, message, depth, whole, hash) of passages (whole) and of the single lines of longer ones.

    messages: _t, _n, message, body. A line is a row, so its marks are parsed once; a passage is a run of lines of one
    depth, found by a window over the lines of one message and put together by a group. Copies of a message count once
    a copy.
    """
    copies = messages.where("message is not null").groupBy("_t", "_n", "message", "body").agg(F.count("*").alias("copies"))
    key = ["_t", "_n", "message", "copy"]
    lines = copies.select("_t", "_n", "message", F.xxhash64("body").alias("copy"), "copies", F.posexplode(_lines(F.col("body"))).alias("at", "line"))
    lines = lines.withColumn("marks", F.when(F.startswith("line", F.lit(">")), F.regexp_extract("line", _QUOTE, 1)).otherwise(""))
    lines = lines.withColumns({"depth": F.length(F.regexp_replace("marks", r"[ \t]", "")), "words": F.expr("substr(line, length(marks) + 1)")}).drop("line", "marks")
    order = W.partitionBy(*key).orderBy("at")
    begins = F.coalesce(F.col("depth") != F.lag("depth").over(order), F.lit(True))
    runs = lines.withColumn("begins", begins).withColumns({"run": F.count_if("begins").over(order.rowsBetween(W.unboundedPreceding, 0)), "alone": F.col("begins") & F.lead("begins", 1, True).over(order)})
    single = runs.select("_t", "_n", "message", "depth", F.col("alone").alias("whole"), "copies", F.col("words").alias("text"))
    longer = runs.where("not alone").groupBy(*key, "run").agg(F.first("depth").alias("depth"), F.first("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("at", "words"))).alias("own"))
    text = F.array_join(F.col("own.words"), "\n")
    units = single.union(longer.select("_t", "_n", "message", "depth", F.lit(True), "copies", text))
    hashed = units.withColumn("norm", normalised(F.col("text"))).where("norm <> ''")
    return hashed.select("_t", "_n", "message", "depth", "whole", "copies", F.sha2("norm", 256).alias("hash"))


def link_quotes(messages: DataFrame, thread: str = "thread", message: str = "message", body: str = "body") -> DataFrame:
    """thread, message, parent, root, reply_depth, n_passages, n_linked, clean_text for each row of messages.

    message orders the messages of a thread and names them; a parent is always smaller. Passages are quotes of any
    depth with a word in them; one is linked if an earlier message of the thread wrote the same passage, or one of the
    passage's lines, at depth 0, and then belongs to the earliest such message. The parent is the message of a depth-1
    quote: of whole passages before single lines, then the latest. Rows that repeat a (thread, message) are copies of
    one message and share its links; a null thread is a thread like others; a row with a null message has no parent,
    no root and depth 0. A null body is empty. reply_depth 0 and root = message mark messages that quote nothing known;
    reply_ordered() puts the rows in conversation order. Empty tables give empty tables; other columns are not read.
    """
    rows = messages.select(F.col(thread).alias("thread"), F.col(message).alias("message"), F.col(body).alias("body"))
    rows = rows.withColumns({"_t": F.coalesce(F.col("thread").cast("string"), F.lit("")), "_n": F.col("thread").isNull()})
    keyed, _ = common.stored(_units(rows), "quotes")

    wrote = keyed.where("depth = 0").groupBy("_t", "_n", "hash").agg(F.min("message").alias("origin"))
    quoted = keyed.where("depth > 0").groupBy("_t", "_n", "message", "depth", "whole", "hash").agg(F.sum("copies").alias("n"))
    linked = quoted.join(wrote, ["_t", "_n", "hash"], "left").withColumn("origin", F.when(F.col("origin") < F.col("message"), F.col("origin")))
    per = linked.groupBy("_t", "_n", "message").agg(
        F.sum(F.when(F.col("whole"), F.col("n"))).alias("n_passages"),
        F.sum(F.when(F.col("whole") & F.col("origin").isNotNull(), F.col("n"))).alias("n_linked"),
        F.coalesce(F.max(F.when(F.col("whole") & (F.col("depth") == 1), F.col("origin"))), F.max(F.when(F.col("depth") == 1, F.col("origin")))).alias("parent"),
    )
    per, _ = common.stored(per, "quote-parents")
    rooted = _roots(per.where("parent is not null").select("_t", "_n", "message", "parent"))
    nodes = per.join(rooted, ["_t", "_n", "message"], "left")
    own = F.filter(_lines(F.col("body")), lambda line: ~F.startswith(line, F.lit(">")))  # lines of depth 0
    out = rows.withColumn("clean_text", F.trim(F.array_join(own, "\n"))).drop("body").join(nodes, ["_t", "_n", "message"], "left")
    return out.select(
        "thread",
        "message",
        "parent",
        F.coalesce("root", "message").alias("root"),
        F.coalesce("reply_depth", F.lit(0).cast("long")).alias("reply_depth"),
        F.coalesce("n_passages", F.lit(0).cast("long")).alias("n_passages"),
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
        "clean_text",
    )


def reply_ordered(linked: DataFrame) -> DataFrame:
    """Rows of link_quotes() as conversations: all rows sorted by thread, first message, depth of reply and message.

    Rows are dealt by ranges of that order, so a conversation of any length is no single task's; partitions follow each
    other in order. Nulls come first; copies of a message stand side by side.
    """
    order = ["thread", "root", "reply_depth", "message"]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)


def _roots(parents: DataFrame) -> DataFrame:
    """(_t, _n, message, root, reply_depth) of messages with a parent: each round doubles how far a pointer reaches.

    A pointer at a message without a parent is finished and moves no more; others step on through it.
    """
    key = ["_t", "_n"]
    replies = parents.select(*key, F.col("message").alias("up"), F.lit(False).alias("top"))
    at = parents.withColumnRenamed("parent", "up").join(replies, [*key, "up"], "left")
    at = at.select(*key, "message", "up", F.lit(1).cast("long").alias("hops"), F.coalesce("top", F.lit(True)).alias("done"))
    at, path = common.stored(at, "quote-roots")
    while at.where("not done").limit(1).count():  # a parent is smaller than its reply: pointers end
        above = at.select(*key, F.col("message").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("done").alias("done2"))
        moved = at.where("not done").join(above, [*key, "up"]).select(*key, "message", F.col("up2"), F.col("hops") + F.col("hops2"), "done2")
        before = path
        at, path = common.stored(at.where("done").union(moved), "quote-roots")
        common.remove(parents.sparkSession, before)
    return at.select(*key, "message", F.col("up").alias("root"), F.col("hops").alias("reply_depth"))


def as_mail(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, text) as mail: each turn under the quoted last turn, which quotes the one before.

    Copies of one turn are quoted as the smallest of their texts.
    """
    said = conversations.where("conv_id is not null and turn is not null and text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    back = lambda n: said.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("said").alias(f"said{n}"))
    quoted = lambda c, mark: F.regexp_replace(F.col(c), r"(?m)^", mark)
    mail = conversations.select("conv_id", "turn", "text").join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    parts = F.concat_ws("\n", F.when(F.col("said1").isNotNull(), quoted("said2", ">> ")), quoted("said1", "> "), F.col("text"))
    return mail.select("conv_id", "turn", parts.alias("body"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as mail, in reply order: quotes that texts hold themselves count like those that as_mail() adds."""
    mail, _ = common.stored(as_mail(common.table(spark, sf_dir, "conversations")), "mail")
    out = reply_ordered(link_quotes(mail, "conv_id", "turn", "body"))
    return out.select(F.col("thread").alias("conv_id"), F.col("message").alias("turn"), F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), "reply_depth", "n_passages", "n_linked", F.sha2("clean_text", 256).alias("clean_sha256"))


QUERIES = {"op1_quote_links": query}
