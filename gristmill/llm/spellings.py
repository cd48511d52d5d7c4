"""Spelling variants: words one edit apart, found by asymmetric chunks.

Of two words one edit apart, the shorter (of equal lengths the smaller) contributes two
disjoint chunks, its halves. One edit leaves one of them whole, and it stands in the
other word at the same place or, counted from the front, one further. The other word
contributes its positional grams: for each length the partner can have, the grams where
that partner's chunks would stand, counted from its start and from its end, which joins
them within a shift of one. Candidates are verified by their edit distance.

A chunk that too many words share is not compared in place. Its words are joined again
on the same terms by chunks of what the chunk leaves over: the edit lies there, so one
of the two halves of the rest is whole too. This goes on until a group is small or one
character is left, which alone can differ; nothing is lost and no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.storage import written

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs of a chunk group that are compared in place.
GROUP_PAIRS = 4096


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 5, least_count: int = 3, noise: int = 97) -> DataFrame:
    """(word, n) of the words with ``least_chars`` code points and ``least_count`` occurrences.

    Words are letter runs with A-Z in lower case. A run whose CRC-32 with the key of its
    text is divisible by ``noise`` has lost one code point, the remainder of the CRC-32 by
    its length; 0 leaves all whole. Null texts have no words; a null key counts as empty.
    Counts are combined before the shuffle, so a very common word is one row a task.
    """
    body = F.col(text).cast("string")
    # shorter runs cannot give words
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"),
        body.rlike(r"[À-Þ]").alias("__capitals"),
        F.regexp_extract_all(body, F.lit(f"{RUN}{{{least_chars},}}"), F.lit(0)).alias("__runs"),
    )
    # apart from the line above, which else looks through a text for each of its runs
    runs = runs.select("__key", "__capitals", F.explode("__runs").alias("__run"))
    # lower() changes capitals beyond Z as well, so it serves where the text has none
    run = F.when(F.col("__capitals"), F.translate("__run", UPPER, LOWER)).otherwise(F.lower("__run"))
    words = runs.select("__key", run.alias("word"))
    if noise:
        h = F.crc32(F.concat("__key", F.lit(":"), "word"))
        words = words.select("word", h.alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("word")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= least_count) & (F.length("word") >= least_chars))


def _part(word: Column, start: Column, size: Column) -> Column:
    return F.substring(word, (start + 1).cast("int"), size.cast("int"))


def _halves(rows: DataFrame) -> DataFrame:
    """Signatures by the halves of what is left over of each row's word.

    ``at`` and ``rest`` say what is left of the chunk word; a gram word's rest is longer
    by ``more``. The left half stays at ``at``; the right half of a gram word stands
    ``more`` further. ``same`` lists the halves that must differ for a pair to count, so
    that it is found under one key only: a right half counts where the left one differs.
    """
    half = F.floor(F.col("rest") / 2).cast("int")
    left = F.struct(
        F.lit("l").alias("side"), _part(F.col("word"), F.col("at"), half).alias("chunk"),
        (F.col("at") + half).alias("at"), (F.col("rest") - half).alias("rest"),
        F.col("differ").alias("differ"),
    )
    right = F.struct(
        F.lit("r").alias("side"), _part(F.col("word"), F.col("at") + half + F.col("more"), F.col("rest") - half).alias("chunk"),
        F.col("at").alias("at"), half.alias("rest"),
        F.concat("differ", F.array(_part(F.col("word"), F.col("at"), half))).alias("differ"),
    )
    made = rows.select("key", "word", "n", "is_chunk", "more", F.explode(F.array(left, right)).alias("s"))
    key = F.concat_ws("\u0001", "key", "s.side", "s.chunk")
    return made.select(key.alias("key"), "word", "n", "is_chunk", "more", "s.at", "s.rest", "s.differ")


def near_pairs(words: DataFrame, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(a, n_a, b, n_b) of all pairs of ``words`` (distinct ``word``, ``n``) one inserted,
    deleted or replaced code point apart; each pair once."""
    size = F.length("word")
    more = lambda k: F.struct(F.lit(False).alias("is_chunk"), F.lit(k).alias("more"), (size - k).alias("rest"))
    chunk = F.struct(F.lit(True).alias("is_chunk"), F.lit(0).alias("more"), size.alias("rest"))
    roles = words.select("word", "n", F.explode(F.array(chunk, more(0), more(1))).alias("r"))
    # a chunk word meets gram words of its own length and those one longer
    rows = roles.select(
        F.col("r.rest").cast("string").alias("key"), "word", "n", "r.is_chunk", "r.more",
        F.lit(0).alias("at"), "r.rest", F.array().cast("array<string>").alias("differ"),
    )
    found, level = [], _halves(rows)
    while True:
        level = written(level, "chunks")
        sizes = level.groupBy("key").agg(F.count_if("is_chunk").alias("c"), F.count_if(~F.col("is_chunk")).alias("g"))
        # a word meets itself among the grams of its own length
        sizes = sizes.where((F.col("c") > 0) & (F.col("g") > 1))
        crowded = (F.col("c") * F.col("g") > group_pairs).alias("crowded")
        live = written(level.join(sizes.select("key", crowded), "key"), "groups")
        # with one character left over, all words of a group are one edit apart
        in_place = ~F.col("crowded") | (F.col("rest") <= 1)
        a = live.where(F.col("is_chunk") & in_place).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("differ").alias("x"))
        b = live.where(~F.col("is_chunk") & in_place).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("differ").alias("y"), "more")
        once = (F.col("more") == 1) | (F.col("a") < F.col("b"))
        apart = ~F.exists(F.zip_with("x", "y", lambda p, q: p == q), lambda same: same)
        near = F.levenshtein("a", "b", 1) == 1
        found.append(a.join(b, "key").where(once & apart & near).select("a", "n_a", "b", "n_b"))
        level = live.where(~in_place)
        if level.isEmpty():
            break
        level = _halves(level.drop("crowded"))
    pairs = found[0]
    for other in found[1:]:
        pairs = pairs.unionByName(other)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of each chain of forms, the word
    itself where it has none. Chains must not run in circles. Each round follows twice
    as many steps."""
    current = written(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        # ends lead to themselves and need no step
        steps = current.where("word != root").select(F.col("word").alias("from"), F.col("root").alias("to"))
        moved = written(
            current.join(steps, current["root"] == steps["from"], "left").select(
                "word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")
            ),
            "roots",
        )
        current = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return current


def variants(words: DataFrame, times: int = 2, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """``words`` (distinct ``word``, ``n``) with ``n_near``, ``form``, ``form_n`` and ``root``.

    ``form`` is the near word of largest ``n``, of equal ones the smallest in code-point
    order, if that ``n`` is at least ``times`` the word's; else null. ``root`` is the last
    form on the way. Forms have larger counts with ``times`` above 1, so ways end.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    words = words.select("word", "n")
    pairs = near_pairs(words, group_pairs)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    both = pairs.select(F.explode(ends).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    fits = -F.col("best.rank") >= times * F.col("n")
    named = written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.rank")).alias("form_n"),
        ),
        "forms",
    )
    return named.join(roots(named), "word")


def group_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 5, least_count: int = 3, noise: int = 97) -> DataFrame:
    """``variants`` of the words of ``docs``; no words give no rows."""
    words = written(word_counts(docs, key, text, least_chars, least_count, noise), "words")
    return variants(words)
