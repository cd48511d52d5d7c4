"""Quotation linking: conversations rebuilt from who quotes whom.

Quote markers are brought to one form, so a line's level is its number of ``>``.
Consecutive lines of one level are a quoted block; blocks and their paragraphs
are passages, as are every message's own words and their paragraphs. Passages are
compared by a hash of their normalised text. A message answers the earliest
message whose own passage it quotes at the lowest level; where that message is
missing, the next level's original takes its place.

Everything is DataFrame functions. Passages that thousands of messages share are
reduced to their earliest message before the join, and those that thousands quote are
joined without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.storage import written

#: Normalised passages shorter than this many characters link nothing.
MIN_CHARS = 8
#: A join treats at most so many keys as hot, each with more than MIN_HOT rows.
HOT_KEYS = 1000
MIN_HOT = 100
#: A line that announces a quote: one of these words and a colon at its end.
ANNOUNCE = r"(?m)^[^\n>]{0,200}\b(?:wrote|schrieb|écrit|escribió)[^\n]{0,20}:[ \t]*\n(?=>)"
_BLOCK = r"(?m)^(>+)(?!>)[^\n]*+(?:\n\1(?!>)[^\n]*+)*+"


def _canonical(text: Column) -> Column:
    """Lines end with a line feed alone; markers stand at the line's start without gaps."""
    text = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\r\n?", "\n")
    return F.regexp_replace(text, r"(?m)(?:^|\G(?!^))[ \t]*>", ">")


def own_words(text: Column) -> Column:
    """The text without quoted lines and the lines that announce them."""
    text = F.regexp_replace(_canonical(text), ANNOUNCE, "")
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^>[^\n]*\n?", ""), r"^\s++|(?<!\s)\s++$", "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s++", " "))


def _passages(text: Column) -> Column:
    """The whole and, if there are several, its paragraphs: array<struct<hash, chars>>."""
    parts = F.split(text, r"\n[ \t]*+\n\s*+")
    whole = F.array(text)
    every = F.array_distinct(F.transform(F.when(F.size(parts) > 1, F.concat(whole, parts)).otherwise(whole), normalised))
    long = F.filter(every, lambda p: F.length(p) >= MIN_CHARS)
    return F.transform(long, lambda p: F.struct(F.unhex(F.sha2(p, 256)).alias("hash"), F.length(p).alias("chars")))


def _blocks(text: Column) -> Column:
    """array<struct<level, text>> of the quoted blocks."""
    return F.transform(
        F.regexp_extract_all(_canonical(text), F.lit(_BLOCK), 0),
        lambda b: F.struct(
            F.length(F.regexp_extract(b, r"^>+", 0)).alias("level"), F.regexp_replace(b, r"(?m)^>+ ?", "").alias("text")
        ),
    )


def _with_one(many: DataFrame, ones: DataFrame, key: str, how: str) -> DataFrame:
    """Written ``many`` joined with written ``ones``, which has a row per key at most.

    A key with more than a share of 1 / HOT_KEYS of the rows is hot; there are fewer than
    HOT_KEYS of those, whatever the size of the table, so their rows of ``ones`` are
    broadcast and the rows of ``many`` stay where they are. All others are shuffled."""
    least = many.count() // HOT_KEYS + MIN_HOT
    hot = written(many.groupBy(key).count().where(F.col("count") > least).select(key), "hot")
    if hot.isEmpty():
        return many.join(ones, key, how)
    few = F.broadcast(written(ones.join(F.broadcast(hot), key, "left_semi"), "hot_ones"))
    common = many.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    others = many.join(F.broadcast(hot), key, "left_anti").join(ones, key, how)
    return common.unionByName(others)


def parents(messages: DataFrame, key: str, text: str = "text", order: str | None = None) -> DataFrame:
    """(``key``, parent): each message's original, null without one. ``order`` tells
    which messages came before (default: the key); originals precede their quotes."""
    frame = messages.where(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.col(order or key).alias("at"), F.col(text).alias("text")
    )
    firsts = written(
        frame.select("id", "at", F.explode(_passages(own_words(F.col("text")))).alias("p"))
        .groupBy("p.hash")
        .agg(F.min(F.struct("at", "id")).alias("first")),
        "originals",
    )
    quoted = written(
        frame.where(F.col("text").contains(">"))
        .select("id", "at", F.explode(_blocks(F.col("text"))).alias("b"))
        .select("id", "at", "b.level", F.explode(_passages(F.col("b.text"))).alias("p"))
        .select("id", "at", "level", "p.hash", "p.chars"),
        "quoted",
    )
    found = (
        _with_one(quoted, firsts, "hash", "inner")
        .where(F.struct("first.at", "first.id") < F.struct("at", "id"))
        .groupBy("id")
        .agg(F.min(F.struct("level", (-F.col("chars")).alias("short"), "first")).alias("best"))
        .select("id", F.col("best.first.id").alias("parent"))
    )
    return frame.select("id").distinct().join(found, "id", "left").select(F.col("id").alias(key), "parent")


def roots(links: DataFrame, key: str) -> DataFrame:
    """(``key``, parent, root, depth) from (``key``, parent). The known distance
    doubles each round; messages that have reached their root leave the rounds, so
    only those on the way are joined. Links must not form a cycle."""
    links = written(links.select(F.col(key).alias("id"), "parent"), "replies")
    top = links.where("parent is null").select("id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("depth"))
    # a parent that is not among the messages ends the way as well
    step = links.where("parent is not null")
    ends = _with_one(step, links.select(F.col("id").alias("parent"), F.col("parent").alias("next")), "parent", "left")
    state = ends.select("id", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("depth"), F.col("next").isNull().alias("done"))
    state = written(state, "ways")
    done = [top, state.where("done").select("id", F.col("up").alias("root"), "depth")]
    going = state.where("not done")
    while not going.isEmpty():
        # the way of each message's ancestor, finished or not
        finished = done[1]
        for more in done[2:]:
            finished = finished.unionByName(more)
        ways = finished.select(F.col("id").alias("up"), F.col("root").alias("next"), F.col("depth").alias("more"), F.lit(True).alias("ended")).unionByName(
            going.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.lit(False).alias("ended"))
        )
        state = written(
            going.join(ways, "up").select(
                "id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ended").alias("done")
            ),
            "ways",
        )
        done.append(state.where("done").select("id", F.col("up").alias("root"), "depth"))
        going = state.where("not done")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return links.join(result, "id").select(F.col("id").alias(key), "parent", "root", "depth")


def conversations(messages: DataFrame, key: str, text: str = "text", order: str | None = None) -> DataFrame:
    """(``key``, conversation, parent, depth, body), sorted by conversation and
    order, so that every answer follows what it answers; ``body`` has no quotes.

    ``conversation`` is the key of the first message. Messages that quote nothing
    known start one. Null texts are empty, messages without a key are left out,
    repeated keys keep all rows with one parent. Passages under eight normalised
    characters and those found first in a later message link nothing; of equal
    originals the earliest counts.
    """
    known = roots(parents(messages, key, text, order), key)
    bodies = messages.select(F.col(key), F.col(order or key).alias("__at"), own_words(F.col(text)).alias("body"))
    named = bodies.join(known, key).orderBy("root", "__at", key)
    return named.select(key, F.col("root").alias("conversation"), "parent", "depth", "body")
