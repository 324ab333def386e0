"""Quotation linking, by DataFrame functions: quote levels, hashes of quoted passages, links to original messages, reply order.

A line's level is the number of `>` that lead it, blanks between them allowed. Lines of one level that follow each other
are a passage. A quoted passage (level 1 or more) is known by the hash of its normalised text (lower-case words joined by
one blank); so are the units of every message's own text (level 0): the whole message, its passages and its lines. A
passage links to the earliest own text with its hash that stands before it in its own conversation, else to the earliest
one, by (conv_id, turn), of any other conversation, whichever number that has; its lines are linked in the same way.
`links` returns all of these. A message replies to one original: whole passages come before lines, outer quotes before
inner ones, the latest message first. Replies between conversations may run in a circle; of those on it or leading to it,
links to a later (conv_id, turn) are then no replies.

Conversations are rebuilt by following replies to their first message: thread_conv and thread_turn name it, depth counts
the replies between. Ordered by (thread_conv, thread_turn, depth, conv_id, turn), every message follows what it answers;
a message that answers nothing stands for its own conversation, as depth 0 by its turn.

Nulls, ties and odd rows: a null text is empty; rows without conv_id or turn are linked to nothing; quoted passages
without a word are ignored; rows that repeat conv_id and turn are one message to those who quote it and rows of their own
in the result; equal originals: the earliest by (conv_id, turn). Other columns than conv_id, turn, role, text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

MARKS = r"^(\s*>)+"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), common.BETWEEN_WORDS, " "))


def key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("quote"), text).alias("b"))


def passages(chats: DataFrame) -> DataFrame:
    """id (conv_id, turn), passage number, level, lines: all passages of all messages, in order."""
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"\s", "")).alias("level"), F.regexp_replace(x, MARKS + r" ?", "").alias("line")),
    )
    passage = "array<struct<level:int,lines:array<string>>>"
    # Passages begin where the level changes; one-element arrays bind the lines and these places, so no line is copied twice.
    begins = F.transform(
        F.array(lines),
        lambda x: F.struct(x.alias("x"), F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["level"] != F.get(x, i - 1)["level"])).alias("at")),
    )

    def cut(s, k):
        first = F.get(s["at"], k)
        own = F.slice(s["x"], first + 1, F.coalesce(F.get(s["at"], k + 1), F.size(s["x"])) - first)
        return F.struct(F.get(s["x"], first)["level"].alias("level"), F.transform(own, lambda x: x["line"]).alias("lines"))

    grouped = F.transform(begins, lambda s: F.transform(F.sequence(F.lit(0), F.size(s["at"]) - 1), lambda k: cut(s, k)))[0].cast(passage)
    # Most messages quote nothing; they are one passage as they stand.
    plain = F.array(F.struct(F.lit(0).alias("level"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))).cast(passage)
    return chats.select("conv_id", "turn", "role", F.when(F.contains(F.coalesce("text", F.lit("")), F.lit(">")), grouped).otherwise(plain).alias("passages"))


def quoted(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, nr, level, lines of the passages of level 1 or more."""
    quotes = parsed.where(F.exists("passages", lambda p: p["level"] > 0)).select("conv_id", "turn", F.posexplode("passages").alias("nr", "p")).where("p.level > 0")
    return common.stored(quotes.select("conv_id", "turn", "nr", "p.level", "p.lines"), "quotes")


def link(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text (without quotes), quote_levels, reply_conv, reply_turn, thread_conv, thread_turn, depth."""
    parsed = passages(chats.select("conv_id", "turn", "role", "text"))
    known = "conv_id is not null and turn is not null"
    quotes = quoted(parsed.where(known))
    if quotes.isEmpty():
        replies = quotes.select("conv_id", "turn", F.col("conv_id").alias("reply_conv"), F.col("turn").alias("reply_turn"))
    else:
        replies = common.stored(originals(parsed.where(known), quotes), "replies")
    rooted = threads(replies)
    own = F.filter("passages", lambda p: p["level"] == 0)
    text = F.trim(F.array_join(F.flatten(F.transform(own, lambda p: p["lines"])), "\n"))
    levels = F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0))
    messages = parsed.select("conv_id", "turn", "role", text.alias("own_text"), levels.alias("quote_levels"))
    return messages.join(rooted, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "own_text", "quote_levels", "reply_conv", "reply_turn",
        F.coalesce("thread_conv", "conv_id").alias("thread_conv"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def linked(parsed: DataFrame, quotes: DataFrame) -> DataFrame:
    """conv_id, turn, nr, level, line (-1: the whole passage) and to, the original, of every quoted passage and line that is found."""
    whole = normal(F.array_join("lines", " "))
    asked = quotes.select("conv_id", "turn", "nr", "level", F.lit(-1).alias("line"), whole.alias("norm"))
    asked = asked.unionAll(quotes.select("conv_id", "turn", "nr", "level", F.posexplode("lines").alias("line", "norm")).withColumn("norm", normal(F.col("norm")))).where("norm <> ''").withColumn("key", key(F.col("norm"))).drop("norm")
    own = F.filter("passages", lambda p: p["level"] == 0)
    texts = F.transform(own, lambda p: F.array_join(p["lines"], " "))
    units = F.concat(F.array(F.array_join(texts, " ")), texts, F.flatten(F.transform(own, lambda p: p["lines"])))
    unit = parsed.select("conv_id", "turn", F.explode(units).alias("unit")).select("conv_id", "turn", normal(F.col("unit")).alias("norm")).where("norm <> ''").select("conv_id", "turn", key(F.col("norm")).alias("key"))
    # Only units that somebody quotes go on; of each, the earliest message by conversation, and the earliest of the two
    # first conversations, of which one at least is not the quoting message's. All are partial minima.
    unit = unit.join(asked.select("key").distinct(), "key", "left_semi")
    near = common.stored(unit.groupBy("key", "conv_id").agg(F.min("turn").alias("near")), "units")
    first = near.groupBy("key").agg(F.min(F.struct("conv_id", F.col("near").alias("turn"))).alias("far"))
    second = near.join(first, "key").where(F.col("conv_id") != F.col("far.conv_id")).groupBy("key").agg(F.min(F.struct("conv_id", F.col("near").alias("turn"))).alias("other"))
    asked = common.stored(asked, "asked")
    counts = asked.groupBy("key").agg(F.count("*").alias("n"))
    far = common.join_counted(asked, counts.join(first, "key").join(second, "key", "left"), ["key"]).drop("n")
    met = far.join(near, ["key", "conv_id"], "left")
    here = F.when(F.col("near") < F.col("turn"), F.struct("conv_id", F.col("near").alias("turn")))
    there = F.when(F.col("far.conv_id") != F.col("conv_id"), F.col("far")).otherwise(F.col("other"))
    return met.withColumn("to", F.coalesce(here, there)).where("to is not null").select("conv_id", "turn", "nr", "level", "line", "to")


def originals(parsed: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_conv, reply_turn) of every message with a quote that can be linked."""
    met = linked(parsed, quotes)
    # Whole passages before lines, outer levels before inner ones, the latest original first.
    best = met.groupBy("conv_id", "turn").agg(F.max(F.struct((F.col("line") < 0).alias("w"), (-F.col("level")).alias("l"), F.col("to"))).alias("best"))
    return best.select("conv_id", "turn", F.col("best.to.conv_id").alias("reply_conv"), F.col("best.to.turn").alias("reply_turn"))


def links(chats: DataFrame) -> DataFrame:
    """Every link of a quote: conv_id, turn, passage number, level, line (-1: the whole passage), original_conv and original_turn."""
    parsed = passages(chats.select("conv_id", "turn", "role", "text")).where("conv_id is not null and turn is not null")
    met = linked(parsed, quoted(parsed))
    return met.select("conv_id", "turn", F.col("nr").alias("passage"), "level", "line", F.col("to.conv_id").alias("original_conv"), F.col("to.turn").alias("original_turn"))


def threads(links: DataFrame) -> DataFrame:
    """links with the first message of each thread and the number of replies to it, by doubling the steps taken.

    A thread of n links ends within log2(n) + 1 rounds. What has not ended by then is on a circle or leads to one: its links
    to later messages are cut, of which every circle has one, and the rounds begin again.
    """
    most = links.count().bit_length() + 1
    now = links.withColumns({"thread_conv": F.col("reply_conv"), "thread_turn": F.col("reply_turn"), "depth": F.lit(1).cast("long")})
    for step in range(most + 1):
        up = now.select(F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"), F.col("thread_conv").alias("c"), F.col("thread_turn").alias("t"), F.col("depth").alias("d"))
        going = now.join(up.select("thread_conv", "thread_turn"), ["thread_conv", "thread_turn"], "left_semi")
        if now.isEmpty() or going.isEmpty():
            return now
        if step == most:
            later = F.struct("reply_conv", "reply_turn") > F.struct("conv_id", "turn")
            cut = going.where(later).select("conv_id", "turn")
            return threads(common.stored(links.join(cut, ["conv_id", "turn"], "left_anti"), "replies"))
        joined = now.join(up, ["thread_conv", "thread_turn"], "left")
        now = common.stored(
            joined.select("conv_id", "turn", "reply_conv", "reply_turn", F.coalesce("c", "thread_conv").alias("thread_conv"), F.coalesce("t", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")), "threads"
        )
    return now


def report(chats: DataFrame) -> DataFrame:
    """link() with a digest of own_text in its place."""
    return link(chats).withColumn("own_sha256", F.sha2("own_text", 256)).withColumn("own_chars", F.length("own_text").cast("long")).drop("own_text")
