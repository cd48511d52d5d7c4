"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document when at least ``containment`` of its distinct
word shingles occur in the document. Items are partitioned by their number of
shingles; a partition's sketch keeps the s smallest shingle hashes of an item,
with s = n - ceil(containment * n) + 1. A document that holds the item misses at
most s - 1 of its shingles, so it holds one of the sketch: sketches of short items
find their place inside texts of any length, and no contained item is missed.
(Banded MinHash signatures of whole documents would miss most: next to a long
document an item's resemblance is close to zero.)

Documents are read once. Their shingle hashes are looked up in two bitmaps of
fixed size made from the items' sketches and from all their shingles; documents
that meet a sketch bit hand on the text of the shingles that meet a shingle bit.
Shingle texts are then joined and counted, so the containment that decides is
exact whatever the bitmaps or hashes do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.arrow_text import LOWER, LOWER_TABLE, find_words, mixed, span_hashes, text_slices, window_hashes
from gristmill.llm.storage import send_code, shared_value

#: log2 of the bits of a bitmap: 2^25 bits are 4 MB, whatever the benchmark's size.
BITMAP_BITS = 25


def _windows(data: np.ndarray, words, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, number of words) of all windows of the given sizes."""
    hashes = span_hashes(data, words.starts, words.ends)
    found = [(*window_hashes(hashes, words, n), n) for n in sizes]
    return (
        np.concatenate([at for at, _, _ in found]),
        # equal words in windows of different sizes are different shingles
        np.concatenate([h if n == max(sizes) else mixed(h + np.uint64(n)) for _, h, n in found]),
        np.concatenate([np.full(len(at), n) for at, _, n in found]),
    )


def _shingle_rows(texts: pa.Array, size: int, shorter: list[int], wanted) -> Iterator[tuple]:
    """(row, hash, shingle text) of the distinct shingles of each row that ``wanted``
    keeps; it gets (rows, hashes, sizes, words of each row) of all windows of a slice."""
    for first, data, offsets in text_slices(texts):
        data = LOWER_TABLE[data]
        words = find_words(data, offsets)
        at, hashes, n = _windows(data, words, [size, *shorter])
        keep = wanted(words.row[at], hashes, n, np.diff(words.first))
        if not keep.any():
            continue
        at, hashes, n = at[keep], hashes[keep], n[keep]
        raw = data.tobytes()
        seen = set()
        for w, h, width in zip(at.tolist(), hashes.view(np.int64).tolist(), n.tolist(), strict=True):
            row = first + int(words.row[w])
            shingle = b" ".join(raw[words.starts[w + k] : words.ends[w + k]] for k in range(width)).decode()
            if (row, shingle) not in seen:
                seen.add((row, shingle))
                yield row, h, shingle


def _batches(rows: Iterator[tuple], batch: pa.RecordBatch, keys: list[str], schema: pa.Schema):
    at, hashes, shingles = [], [], []

    def made() -> pa.RecordBatch:
        own = [batch.column(batch.schema.get_field_index(k)).take(pa.array(at, pa.int64())) for k in keys]
        return pa.RecordBatch.from_arrays(
            [*own, pa.array(hashes, pa.int64()), pa.array(shingles, pa.string())], [*keys, "__hash", "__shingle"]
        )

    for row, h, shingle in rows:
        at.append(row), hashes.append(h), shingles.append(shingle)
        if len(at) >= 20_000:
            yield made()
            at.clear(), hashes.clear(), shingles.clear()
    if at:
        yield made()


def shingles(items: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """keys, ``__hash``, ``__shingle``: the distinct word shingles of each row; of fewer
    words, all of them as one."""
    frame = items.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keys).schema)

    def of(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            yield from _batches(
                _shingle_rows(texts, size, [*range(1, size)], lambda rows, hashes, n, own: (n == size) | (n == own[rows])), batch, keys, None
            )

    send_code(items.sparkSession)
    return frame.mapInArrow(of, f"{schema}, __hash bigint, __shingle string").distinct()


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap over the top ``bits`` bits of the hashes: combined in Spark, at most
    2^(bits - 6) words reach the driver."""
    slot = F.shiftrightunsigned("__hash", 64 - bits)
    rows = (
        hashes.select(F.shiftright(slot, 6).alias("word"), F.expr(f"1L << cast(shiftrightunsigned(__hash, {64 - bits}) & 63 as int)").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _meets(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = hashes >> np.uint64(64 - bits)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def sketch_size(n: int, containment: float) -> int:
    return n - math.ceil(round(containment * n, 9)) + 1


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    keys: list[str],
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 5,
    containment: float = 0.8,
    bitmap_bits: int = BITMAP_BITS,
) -> DataFrame:
    """(keys, ``item``, ``n_shared``, ``n_shingles``, ``containment``) for every
    document row and item it contains.

    A-Z are lower-cased; shingles are ``size`` words joined by a space, counted
    once. An item of fewer words is one shingle, found where its words stand side by
    side; items without a word and null ones never match. Items of equal text are found each under its own id; rows of
    ``docs`` with equal ``keys`` count as one document, as do ``items`` rows with
    equal ids; null keys are keys like any other.
    """
    clash = [k for k in keys if k == item]
    if clash:
        raise ValueError(f"rename the key columns {clash}")
    known = shingles(items.where(F.col(item).isNotNull()), [item], item_text, size)
    sizes = known.groupBy(item).agg(F.count("*").alias("n_shingles"))
    of_item = sizes.join(known.groupBy(item).agg(F.array_sort(F.collect_set("__hash")).alias("hashes")), item)
    # as an order for MinHash the hashes are compared as signed numbers; distinct shingles of equal hash share a place
    n = F.col("n_shingles")
    kept = n - F.ceil(F.round(n * F.lit(containment), 9)) + 1
    sketch = of_item.select(F.explode(F.slice("hashes", 1, F.greatest(kept, F.lit(1)).cast("int"))).alias("__hash"))
    sketch_bits, all_bits = _bitmap(sketch, bitmap_bits), _bitmap(known, bitmap_bits)
    shared = shared_value(docs.sparkSession, (sketch_bits, all_bits))
    # lengths of items of fewer words, size - 1 at most: documents are searched for windows of these as well
    lengths = known.select(F.size(F.split("__shingle", " ")).alias("n")).where(F.col("n") < size).distinct()
    shorter = sorted(r["n"] for r in lengths.collect())
    frame = docs.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keys).schema)

    def found(batches):
        sketches, every = shared.value

        def wanted(rows, hashes, n, own):
            candidate = np.zeros(len(own), bool)
            candidate[rows[_meets(sketches, hashes, bitmap_bits)]] = True
            return candidate[rows] & _meets(every, hashes, bitmap_bits)

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            yield from _batches(_shingle_rows(texts, size, shorter, wanted), batch, keys, None)

    hits = frame.mapInArrow(found, f"{schema}, __hash bigint, __shingle string")
    pairs = (
        hits.join(known.select(F.col(item), F.col("__hash").alias("__h"), F.col("__shingle").alias("__s")),
                  (F.col("__hash") == F.col("__h")) & (F.col("__shingle") == F.col("__s")))
        .groupBy(*keys, item)
        .agg(F.count_distinct("__shingle").alias("n_shared"))
    )
    return (
        pairs.join(sizes, item)
        .where(F.col("n_shared") >= F.ceil(F.round(n * F.lit(containment), 9)))
        .select(*keys, item, "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    )
