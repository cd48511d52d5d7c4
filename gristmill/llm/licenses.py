"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a line, or a paragraph (lines that follow each other, each with a word).
A block meets a template when it holds at least ``threshold`` of the template's
distinct words. Words that no template has cannot be shared and are left out of a
block from the start.

The join is exact. All words stand in one global order, rarest first, by the number
of blocks that hold them. If a block shares ``need`` words with a template of ``size``
words, the first shared word is among the template's first ``size - need + 1``, so only
those are indexed (prefix filter); blocks of fewer than ``need`` words are left out
(length filter); and from the first shared word on both sides must still have ``need``
words (positional filter). A pair is taken up at its first shared word, hence once.

Everything is DataFrame functions. The text is read once: blocks are written, the
order is counted from them, and the join reads them again. Only the templates and the
counts of their words, both bounded by the ``templates`` argument, reach the driver.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.columns import let, rows
from gristmill.llm.license_texts import PHRASES, TEMPLATES
from gristmill.llm.storage import written

#: What stands between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most distinct words that all templates may have together.
MOST_WORDS = 20_000
_HITS = "array<struct<start:bigint,label:string>>"
_MATCHES = "array<struct<first:int,last:int,label:string,containment:double>>"


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case, for looking words up. Other letters may change
    too, but stay word characters; the one that would become an ASCII letter, the
    Kelvin sign, is another letter here. Null becomes empty."""
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("キ")))


def words_of(wording: str) -> list[str]:
    """Distinct words of a template; what ``lowered`` and ``BETWEEN`` make of a text."""
    return sorted(set(filter(None, re.split(BETWEEN, wording.lower()))))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    need: int


def as_templates(wordings: list[tuple[str, str]], threshold: float) -> list[Template]:
    """Templates with the number of words a block must share; equal ones are one."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    found = dict.fromkeys((label, tuple(words_of(text))) for label, text in wordings)
    made = [Template(label, words, math.ceil(threshold * len(words) - 1e-9)) for label, words in found if words]
    if len({w for t in made for w in t.words}) > MOST_WORDS:
        raise ValueError(f"the templates have over {MOST_WORDS} distinct words; join them in parts")
    return made


def _stands(words: Column, parts: list[str]):
    """Whether the words from place k are ``parts``."""

    def at(k: Column) -> Column:
        fits = F.get(words, k) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            fits = fits & (F.get(words, k + j) == part)
        return fits

    return at


def _phrase_hits(words: Column, phrases: dict[str, str]) -> Column:
    """(start, label) of the places where a phrase's words follow each other."""
    hit = lambda label: lambda k: F.struct(k.cast("bigint").alias("start"), F.lit(label).alias("label"))
    places = F.sequence(F.lit(0), F.size(words) - 1)
    hits = [F.transform(F.filter(places, _stands(words, phrase.split(" "))), hit(label)) for phrase, label in phrases.items()]
    return F.when(F.size(words) > 0, F.concat(F.array().cast(_HITS), *hits)).otherwise(F.array()).cast(_HITS)


def _may_hold(low: Column, phrases: dict[str, str]) -> Column:
    """Whether a text holds all words of a phrase somewhere: spares most texts the search."""
    found = F.lit(False)
    for phrase in phrases:
        every = F.lit(True)
        for word in sorted(set(phrase.split(" ")), key=len, reverse=True):
            every = every & low.contains(word)
        found = found | every
    return found


def _blocks(kept: Column, least: int) -> Column:
    """Blocks of a text given the template words of each line (null for a line without
    any word): lines, and paragraphs of more than one line, with ``least`` words or more."""
    lines = F.transform(kept, lambda ws, i: F.struct((i + 1).alias("first"), (i + 1).alias("last"), ws.alias("words")))
    ends = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.size(kept)), lambda i: F.get(kept, i - 1).isNull()), F.array(F.size(kept) + 1))

    def paragraphs(e: Column) -> Column:
        spans = F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.struct((F.get(e, k - 1) + 1).alias("first"), (F.get(e, k) - 1).alias("last")))
        return F.transform(
            F.filter(spans, lambda s: s["last"] > s["first"]),
            lambda s: F.struct(s["first"], s["last"], F.array_distinct(F.flatten(F.slice(kept, s["first"], s["last"] - s["first"] + 1))).alias("words")),
        )

    return F.filter(F.concat(let(ends, paragraphs), lines), lambda b: F.size(b["words"]) >= least)


def _read(docs: DataFrame, text: str, templates: list[Template], phrases: dict[str, str]) -> DataFrame:
    """``docs`` with ``__row``, ``__n`` words, phrase ``__hits`` and ``__blocks``."""
    known = sorted({w for t in templates for w in t.words})
    least = min((t.need for t in templates), default=0)

    def scanned(low: Column) -> Column:
        split = F.transform(F.split(low, "\n", -1), lambda line: F.filter(F.split(line, BETWEEN, -1), lambda w: w != ""))
        return let(split, lambda lines: F.struct(
            F.aggregate(lines, F.lit(0).cast("bigint"), lambda n, ws: n + F.size(ws)).alias("n"),
            F.when(_may_hold(low, phrases), let(F.flatten(lines), lambda ws: _phrase_hits(ws, phrases)))
            .otherwise(F.array().cast(_HITS)).alias("hits"),
            (let(F.transform(lines, lambda ws: F.when(F.size(ws) > 0, F.array_distinct(F.filter(ws, lambda w: w.isin(known))))),
                 lambda kept: _blocks(kept, least)) if known else F.array().cast("array<struct<first:int,last:int,words:array<string>>>")).alias("blocks")))

    scan = docs.withColumn("__scan", let(lowered(F.col(text)), scanned))
    # the row number is fixed by the write below
    return scan.select(*docs.columns, F.monotonically_increasing_id().alias("__row"),
                       F.col("__scan.n").alias("__n"), F.col("__scan.hits").alias("__hits"), F.col("__scan.blocks").alias("__blocks"))


def _matches(read: DataFrame, templates: list[Template]) -> DataFrame:
    """(__row, first, last, label, containment, shared) of every block and template that meet."""
    spark = read.sparkSession
    blocks = read.select("__row", F.explode("__blocks").alias("b")).select("__row", "b.first", "b.last", "b.words")
    counts = blocks.select(F.explode("words").alias("word")).groupBy("word").count()
    held = {r["word"]: r["count"] for r in counts.collect()}  # template words only
    order = sorted({w for t in templates for w in t.words}, key=lambda w: (held.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    index = []
    for t in templates:
        ranks = sorted(rank[w] for w in t.words)
        for at, r in enumerate(ranks[: len(ranks) - t.need + 1]):
            index.append({"rank": r, "at": at, "label": t.label, "need": t.need, "ranks": ranks})
    if not index:
        return rows(spark, [], "__row bigint, first int, last int, label string, containment double, shared int")
    early = {e["rank"] for e in index}
    ranks_of = F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*(F.lit(k) for k in range(len(order)))))
    near = blocks.where(F.exists("words", lambda w: w.isin([order[r] for r in sorted(early)])))
    near = near.withColumn("own", F.array_sort(F.transform("words", lambda w: F.element_at(ranks_of, w)))).drop("words")
    probes = near.select("*", F.posexplode("own").alias("j", "rank")).where(F.col("rank").isin(sorted(early)))
    table = rows(spark, index, "rank int, at int, label string, need int, ranks array<int>")
    pairs = probes.join(F.broadcast(table), "rank").where(
        (F.size("own") >= F.col("need"))
        & (F.size("own") - F.col("j") >= F.col("need"))
        & (F.size("ranks") - F.col("at") >= F.col("need"))
    )
    shared = F.array_intersect("ranks", "own")
    verified = pairs.withColumn("both", shared).where((F.get("both", F.lit(0)) == F.col("rank")) & (F.size("both") >= F.col("need")))
    return verified.select("__row", "first", "last", "label", (F.size("both") / F.size("ranks")).alias("containment"), F.size("both").alias("shared"))


def scan(
    docs: DataFrame,
    text: str = "text",
    wordings: list[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.9,
    phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """``docs`` with a struct column ``__licenses``: ``n_words``; ``hits``, the places
    (start in words, label) of the phrases; ``matches``, the blocks that meet a template
    as (first line, last line, label, containment), lines counted from 1; ``labels``,
    distinct and sorted, of both; ``score``, the best containment, 1 with a phrase.

    Of the templates a block meets it counts those with the largest containment, of
    these those that share most words; ties all count. Null texts count as empty and
    have nothing. Repeated rows give repeated results. No templates leave the phrases.
    """
    templates = as_templates(wordings, threshold)
    read = written(_read(docs, text, templates, phrases), "blocks")
    found = _matches(read, templates)
    fits = F.struct("containment", "shared").alias("fit")
    # a block has at most one entry for each template, a row one for each label, span and containment
    best = (
        found.groupBy("__row", "first", "last")
        .agg(F.max(fits).alias("best"), F.collect_set(F.struct(fits, "label")).alias("met"))
        .select("__row", F.transform(F.filter("met", lambda m: m["fit"] == F.col("best")),
            lambda m: F.struct("first", "last", m["label"].alias("label"), F.col("best.containment"))).alias("met"))
        .groupBy("__row")
        .agg(F.sort_array(F.flatten(F.collect_list("met"))).alias("__matches"))
    )
    joined = read.join(best, "__row", "left")
    matches = F.coalesce("__matches", F.array().cast(_MATCHES)).cast(_MATCHES)
    labels = F.array_sort(F.array_distinct(F.concat(F.col("__hits.label"), F.transform(matches, lambda m: m["label"]))))
    score = F.when(F.size("__hits") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(matches, lambda m: m["containment"])), F.lit(0.0)))
    licenses = F.struct(F.col("__n").alias("n_words"), F.col("__hits").alias("hits"), matches.alias("matches"), labels.alias("labels"), score.alias("score"))
    return joined.select(*(read[c] for c in docs.columns), licenses.alias("__licenses"))
