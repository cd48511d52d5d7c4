"""Distribution-divergence quality rules.

Base rules count words, symbols, repeated lines and repeated three-word windows.
The method compares two histograms of a document with its language's: shares of
character classes, and shares of the language's most common words (all others
in one bin). The distance is the Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1). Each comparison has a minimum length, below which
a histogram says too little and the rule does not apply.

A language's histograms are sums over all its documents. A language with too little
text for the guards has none, and its documents pass these rules, for there is nothing
to compare them with; documents without a language are compared with the nearest one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.arrow_text import IS_SPACE, find_words, mixed, row_sums, span_hashes, text_slices, window_hashes
from gristmill.llm.storage import send_code, shared_value, written

SYMBOLS = b"#*$%&|<>"
#: Character classes by byte; a character outside ASCII counts once, by its first byte.
CLASSES = ["lower vowel", "lower consonant", "upper", "digit", "space", "line end", "stop", "shout", "symbol", "other ASCII", "Latin", "other"]


def _class_table() -> np.ndarray:
    table = np.full(256, 9, np.uint8)
    for code, members in enumerate([b"aeiou", b"bcdfghjklmnpqrstvwxyz", bytes(range(65, 91)), b"0123456789", b" \t\x0b\x0c", b"\r\n", b".,;:", b"!?", SYMBOLS]):
        table[list(members)] = code
    table[0xC2:0xD0] = 10
    table[0xD0:] = 11
    table[0x80:0xC0] = 255  # continuation bytes
    return table


CLASS_OF = _class_table()
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Reference:
    """Histograms of one language."""

    classes: np.ndarray
    words: np.ndarray  # hashes of the common words, ascending
    shares: np.ndarray  # their shares, and that of all other words last


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` from ``q``; both are shares."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class in each row."""
    kind = CLASS_OF[data]
    rows = len(offsets) - 1
    at = np.repeat(np.arange(rows, dtype=np.int64) * len(CLASSES), np.diff(offsets)) + kind
    return np.bincount(at[kind != 255], minlength=rows * len(CLASSES)).reshape(rows, -1)


def references(
    docs: DataFrame, text: str = "text", lang: str = "lang", common: int = 48,
    min_chars: int = 200, min_words: int = 100, languages: int | None = None,
) -> dict[str, Reference]:
    """The histograms of each language with enough text, over all documents of it. About a
    kilobyte for each reaches the driver and the tasks; ``languages`` bounds them, if given,
    to those of most words. The counts are written once."""
    frame = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null")

    def count(batches):
        for batch in batches:
            langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
            codes, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
            parts = []
            classes = np.zeros((len(names), len(CLASSES)), np.int64)
            for first, data, offsets in text_slices(texts):
                own = codes[first : first + len(offsets) - 1]
                np.add.at(classes, own, class_counts(data, offsets))
                words = find_words(data, offsets)
                hashes = span_hashes(data, words.starts, words.ends)
                for code in np.unique(own):
                    parts.append((code, *np.unique(hashes[own[words.row] == code], return_counts=True)))
            for code, name in enumerate(names):
                mine = [p for p in parts if p[0] == code]
                if mine:
                    every = np.concatenate([p[1] for p in mine])
                    order, at = np.unique(every, return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([p[2] for p in mine]), minlength=len(order)).astype(np.int64)
                else:
                    order, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                keys = np.concatenate([order.view(np.int64), np.arange(len(CLASSES))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(keys), pa.string()),
                        pa.array(np.arange(len(keys)) < len(order)),
                        pa.array(keys),
                        pa.array(np.concatenate([n, classes[code]])),
                    ],
                    ["lang", "is_word", "key", "n"],
                )

    send_code(docs.sparkSession)
    counts = frame.mapInArrow(count, "lang string, is_word boolean, key bigint, n bigint")
    counts = written(counts.groupBy("lang", "is_word", "key").agg(F.sum("n").alias("n")), "counts")
    totals = counts.groupBy("lang").agg(
        F.sum(F.when(F.col("is_word"), F.col("n"))).alias("total"), F.sum(F.when(~F.col("is_word"), F.col("n"))).alias("chars")
    )
    enough = totals.where((F.col("total") >= min_words) & (F.col("chars") >= min_chars)).select("lang", "total")
    if languages is not None:
        enough = enough.orderBy(F.desc("total"), "lang").limit(languages)
    best = Window.partitionBy("lang", "is_word").orderBy(F.desc("n"), "key")
    ranked = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(common, len(CLASSES)))
    rows = ranked.join(enough, "lang").collect()
    out = {}
    of: dict[str, list] = {}
    for r in rows:
        of.setdefault(r["lang"], []).append(r)
    for name in sorted(of):
        words = sorted((r["key"] % (1 << 64), r["n"]) for r in of[name] if r["is_word"] and r["rank"] <= common)
        total = of[name][0]["total"]
        classes = np.zeros(len(CLASSES))
        for r in of[name]:
            if not r["is_word"]:
                classes[r["key"]] = r["n"]
        shares = np.array([n for _, n in words] + [total - sum(n for _, n in words)], float) / total
        out[name] = Reference(classes / classes.sum(), np.array([w for w, _ in words], np.uint64), shares)
    return out


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip("\t\n\x0b\x0c\r "):
            n += line in seen
            seen.add(line)
    return n


def base_counts(texts: pa.Array):
    """Slices of (first row, data, offsets, words, word hashes, base columns)."""
    for first, data, offsets in text_slices(texts):
        words = find_words(data, offsets)
        hashes = span_hashes(data, words.starts, words.ends)
        rows = len(offsets) - 1
        at, windows = window_hashes(hashes, words, 3)
        keyed = windows ^ mixed(words.row[at].astype(np.uint64) + np.uint64(1))  # equal only within a row
        _, where, n = np.unique(keyed, return_inverse=True, return_counts=True)
        again = at[n[where] > 1]
        covered = np.zeros(len(hashes), np.int64)
        for k in range(3):
            covered[again + k] = 1
        inside = ~IS_SPACE[data] & (CLASS_OF[data] != 255)
        base = {
            "n_words": np.diff(words.first),
            "word_chars": row_sums(inside, offsets),
            "n_symbols": row_sums(IS_SYMBOL[data], offsets),
            "n_dup_lines": np.array([_dup_lines(t or "") for t in texts.slice(first, rows).to_pylist()], np.int64),
            "n_repeat_words": row_sums(covered, words.first),
        }
        yield first, data, offsets, words, hashes, base


def check(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    keys: tuple[str, ...] = ("doc_id",),
    common: int = 48,
    min_chars: int = 200,
    min_words: int = 100,
    max_class_distance: float = 0.3,
    max_word_distance: float = 0.5,
    languages: int | None = None,
) -> DataFrame:
    """keys, the base counts, ``class_distance``, ``word_distance`` (null where the
    text is shorter than the guard, or its language has no reference), ``base_failed``
    and ``kept``.

    A null text counts as empty and fails the base rule. Without any language
    the distances are null. Repeated rows give repeated results; columns other
    than ``keys`` are left behind, whatever their names.
    """
    known = references(docs, text, lang, common, min_chars, min_words, languages)
    shared = shared_value(docs.sparkSession, known)
    keys = list(keys)
    frame = docs.select(*keys, F.col(lang).cast("string").alias("__lang"), F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keys).schema)

    def of(batches):
        refs = shared.value
        names = list(refs)
        place_of = {n: k for k, n in enumerate(names)}
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("__lang")).to_pylist()
            texts = batch.column(batch.schema.get_field_index("__text"))
            for first, data, offsets, words, hashes, base in base_counts(texts):
                rows = len(offsets) - 1
                classes = class_counts(data, offsets)
                shares = classes / np.maximum(classes.sum(1, keepdims=True), 1)
                own = np.array([place_of.get(x, -1) for x in langs[first : first + rows]], np.int64)
                class_far = np.full(rows, np.nan)
                for code in np.unique(own[own >= 0]):
                    mine = own == code
                    class_far[mine] = js_distance(shares[mine], refs[names[code]].classes)
                lost = np.flatnonzero([x is None for x in langs[first : first + rows]]) if names else []
                if len(lost):
                    far = np.array([js_distance(shares[lost], refs[n].classes) for n in names])
                    own[lost], class_far[lost] = far.argmin(0), far.min(0)
                word_far = np.zeros(rows)
                for code in np.unique(own[own >= 0]):
                    mine = np.flatnonzero(own == code)
                    ref = refs[names[code]]
                    place = np.full(rows, -1)
                    place[mine] = np.arange(len(mine))
                    take = place[words.row] >= 0
                    at = np.minimum(np.searchsorted(ref.words, hashes[take]), len(ref.words) - 1)
                    at = np.where(ref.words[at] == hashes[take], at, len(ref.words))
                    width = len(ref.words) + 1
                    n = np.bincount(place[words.row][take] * width + at, minlength=len(mine) * width).reshape(-1, width)
                    word_far[mine] = js_distance(n / np.maximum(n.sum(1, keepdims=True), 1), ref.shares)
                class_far = np.where(classes.sum(1) >= min_chars, class_far, np.nan)
                word_far = np.where((base["n_words"] >= min_words) & (own >= 0), word_far, np.nan)
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                kept = ~failed & ~(class_far > max_class_distance) & ~(word_far > max_word_distance)
                own_keys = [batch.column(batch.schema.get_field_index(k)).slice(first, rows) for k in keys]
                made = [pa.array(v) for v in base.values()]
                made += [pc.if_else(pa.array(np.isnan(x)), pa.scalar(None, pa.float64()), pa.array(x)) for x in (class_far, word_far)]
                yield pa.RecordBatch.from_arrays(
                    [*own_keys, *made, pa.array(failed), pa.array(kept)],
                    [*keys, *base, "class_distance", "word_distance", "base_failed", "kept"],
                )

    return frame.mapInArrow(
        of,
        f"{schema}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "class_distance double, word_distance double, base_failed boolean, kept boolean",
    )
