"""Language identification with bit-sliced Bloom filters of letter n-grams.

One table serves all languages: every slot holds a bit mask of languages, and an
n-gram's languages are the bitwise AND of its slots. Per language the n-grams of
a text that hit are counted (population counts of one bit), corrected for the
filter's false-positive rate in that language, and the largest count decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.arrow_text import mixed, row_sums, text_slices
from gristmill.llm.storage import send_code, shared_value

GRAM = 4
#: Slots of the table (a power of two): 2^19 slots of one 64-bit word for each 64 languages.
SLOT_BITS = 19
HASHES = 2
#: Training documents taken per language at most, and n-grams kept per language.
SAMPLE_PER_LANGUAGE = 4000
GRAMS_PER_LANGUAGE = 20_000
#: Languages learned at most.
LANGUAGES = 1024

#: ASCII that is no letter becomes a space; upper case was lowered before.
FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 65 <= b <= 90 and b + 32 or 32 for b in range(256)], np.uint8)


def grams(texts: pa.Array):
    """Slices of (first row, row of each n-gram, the n-gram as a number, row offsets into them).

    N-grams are four bytes of the folded text; runs of spaces count as one and a
    text starts and ends with one. N-grams never cross texts."""
    for first, data, offsets in text_slices(pc.utf8_lower(texts.cast(pa.large_string()))):
        rows = len(offsets) - 1
        # a space before each row and one after the last
        spread = np.full(len(data) + rows + 1, 32, np.uint8)
        row = np.repeat(np.arange(rows), np.diff(offsets))
        spread[np.arange(len(data)) + row + 1] = FOLD[data]
        keep = np.ones(len(spread), bool)
        keep[1:] = (spread[1:] != 32) | (spread[:-1] != 32)
        keep[offsets[:-1] + np.arange(rows)] = True  # each row's own first space
        starts = (np.cumsum(keep) - 1)[offsets[:-1] + np.arange(rows)]
        flat = spread[keep].astype(np.uint64)
        if len(flat) < GRAM:
            yield first, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
            continue
        gram = flat[: len(flat) - GRAM + 1].copy()
        for k in range(1, GRAM):
            gram = gram * np.uint64(256) + flat[k : len(flat) - GRAM + 1 + k]
        # the last n-gram of a row ends with the space that begins the next
        ends = np.append(starts[1:] + 1, len(flat)) - GRAM + 1
        sizes = np.maximum(ends - starts, 0)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + np.repeat(starts, sizes)
        yield first, np.repeat(np.arange(rows), sizes), gram[at], bounds


@dataclass(frozen=True)
class LanguageFilter:
    languages: list[str]  # most frequent first
    table: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray  # by language


def _slots(gram: np.ndarray) -> list[np.ndarray]:
    h = mixed(gram)
    return [(h >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1) for k in range(HASHES)]


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    sample: int = SAMPLE_PER_LANGUAGE,
    keep: int = GRAMS_PER_LANGUAGE,
    salt: str = "language",
    languages: int = LANGUAGES,
) -> LanguageFilter:
    """Learn from the rows with a language: about ``sample`` documents of each,
    chosen by a hash of the text, and the ``keep`` n-grams found in most of them.
    N-grams in a single document are left out unless that is all there is. Of more than
    ``languages`` names those with most documents are learned: the table takes 4 MB for
    each 64 of them."""
    frame = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null")
    counts = frame.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    names = [r["lang"] for r in counts]
    if not names:
        return LanguageFilter([], np.zeros((1 << SLOT_BITS, 1), np.uint64), np.zeros(0))
    unit = F.pmod(F.xxhash64("text", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / r["count"]))])
    chosen = frame.where(unit < F.try_element_at(share, F.col("lang")))

    def count(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes, known = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
            for first, row, gram, _ in grams(batch.column(1).fill_null("")):
                # once per document; n-grams have 32 bits
                once = np.unique((row.astype(np.uint64) << np.uint64(32)) | gram)
                code = codes[first + (once >> np.uint64(32)).astype(np.int64)].astype(np.uint64)
                pairs, n = np.unique((code << np.uint64(32)) | (once & np.uint64(0xFFFFFFFF)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(known).take(pa.array((pairs >> np.uint64(32)).astype(np.int64))),
                        pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                        pa.array(n),
                    ],
                    ["lang", "gram", "n"],
                )

    send_code(docs.sparkSession)
    table = chosen.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = table.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).toArrow()
    slots = np.zeros((1 << SLOT_BITS, (len(names) + 63) // 64), np.uint64)
    of, gram, n = (rows.column(c) for c in ("lang", "gram", "n"))
    of, gram, n = np.array(of.to_pylist(), object), gram.to_numpy().astype(np.uint64), n.to_numpy()
    rates = []
    for code, name in enumerate(names):
        mine = of == name
        if (n[mine] > 1).any():
            mine &= n > 1
        for s in _slots(gram[mine]):
            slots[s, code // 64] |= np.uint64(1 << (code % 64))
        filled = (slots[:, code // 64] >> np.uint64(code % 64) & np.uint64(1)).mean()
        rates.append(filled**HASHES)
    return LanguageFilter(names, slots, np.array(rates))


def corrected_counts(model: LanguageFilter, gram: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows x languages: the n-grams of each row that a language holds, less the
    expected false hits."""
    slots = _slots(gram)
    found = model.table[slots[0]]
    for s in slots[1:]:
        found &= model.table[s]
    total = np.diff(bounds)
    out = np.zeros((len(total), len(model.languages)))
    for code, rate in enumerate(model.false_rate):
        hits = row_sums((found[:, code // 64] >> np.uint64(code % 64)) & np.uint64(1), bounds)
        out[:, code] = np.clip((hits - rate * total) / max(1 - rate, 1e-9), 0, None)
    return out


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, ``lang_pred`` and ``score`` (share of the winner among the corrected counts).

    Null texts, texts without a letter and an empty model give ``und`` and 0. With
    equal counts, none included, the language with more documents wins; without
    any hit its score is 0. Other columns are left behind.
    """
    keys = list(keys)
    shared = shared_value(docs.sparkSession, model)
    frame = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keys).schema)

    def of(batches):
        filters = shared.value
        names = np.array([*filters.languages, "und"], object)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text")).cast(pa.large_string()).fill_null("")
            lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
            for first, _, gram, bounds in grams(texts):
                rows = len(bounds) - 1
                if filters.languages:
                    counts = corrected_counts(filters, gram, bounds)
                    best = counts.argmax(1)
                    score = counts[np.arange(rows), best] / np.maximum(counts.sum(1), 1e-9)
                    none = ~lettered[first : first + rows]
                    best, score = np.where(none, len(names) - 1, best), np.where(none, 0.0, score)
                else:
                    best, score = np.zeros(rows, np.int64), np.zeros(rows)
                own = [batch.column(batch.schema.get_field_index(k)).slice(first, rows) for k in keys]
                made = [pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1))]
                yield pa.RecordBatch.from_arrays([*own, *made], [*keys, "lang_pred", "score"])

    return frame.mapInArrow(of, f"{schema}, lang_pred string, score double")
