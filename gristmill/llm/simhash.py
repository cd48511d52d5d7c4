"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit SimHash of its word shingles. Distinct fingerprints
are hashed under bit masks built from a linear code: bit i gets a non-zero vector
phi(i) of radius + 1 bits, and the table of vector v keeps the bits whose phi(i)
has odd inner product with v. Up to ``radius`` differing bits span a space that
some v is orthogonal to, so every pair within the radius agrees on all bits that
table keeps: no pair is missed.

Buckets with two members are compared in place, those with up to
``bucket_limit`` in one vectorised pass that returns a spanning forest, not pairs.
A larger bucket is hashed again under masks that keep more bits; the same
argument holds within it, so hot buckets lose nothing and no task gathers one. A
bucket whose members vary in no more bits than the radius is linked as a star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.arrow_text import LOWER
from gristmill.llm.components import components
from gristmill.llm.storage import send_code, written

SEED = 42
#: Bytes of a text whose words are listed at once.
PIECE_BYTES = 1 << 20
#: Members of a bucket that one task compares; larger buckets are hashed again.
BUCKET_LIMIT = 2048


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Lists of consecutive words; a long text comes in several."""
    start = 0
    while len(data) - start > PIECE_BYTES:
        end = start + PIECE_BYTES
        while end < len(data) and data[end] not in b"\t\n\x0b\x0c\r ":
            end += 1
        yield data[start:end].split()
        start = end
    yield data[start:].split()


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the ``size``-word shingles, repeats included: A-Z lower-cased,
    words joined by a space, XXH64 with seed 42. A bit is set when over half of
    the hashes have it. Fewer words make one shingle; no word gives 0."""
    digest = xxhash.xxh64_intdigest
    counts, total, tail, whole = np.zeros(64, np.int64), 0, [], []
    for words in _pieces((text or "").encode().translate(LOWER)):
        words = tail + words
        hashes = np.fromiter(
            (digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))), np.uint64
        )
        if len(hashes):
            for k in range(0, len(hashes), 1 << 14):
                bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(0, dtype=np.int64)
            total += len(hashes)
        tail = words[max(0, len(words) - size + 1) :] if size > 1 else []
        whole = words
    if not total:
        return digest(b" ".join(whole), SEED) if whole else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> Column:
    """Column of signed 64-bit fingerprints (null text counts as empty)."""

    send_code(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(docs[text])


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """The 2^(radius+1) - 1 masks of one level, as signed 64-bit numbers. Levels
    deal the vectors to the bits in different fixed orders."""
    vectors = 2 ** (radius + 1) - 1
    order = np.random.RandomState(level).permutation(64)
    phi = [int(order[i]) % vectors + 1 for i in range(64)]
    masks = [sum(1 << i for i in range(64) if (phi[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def spanning_forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, root) for the members within one bucket that a chain of links of
    at most ``radius`` bits joins to another; the roots have no entry."""
    out = []
    left = np.array(prints, np.uint64)
    while len(left):
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= radius
            if near.any():
                found = left[near]
                frontier.extend(found)
                out.extend((int(x), int(root)) for x in found.view(np.int64))
                left = left[~near]
    return [(a, r - (1 << 64) if r >> 63 else r) for a, r in out]


def links(prints: DataFrame, radius: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(a, b) edges between distinct fingerprints (column ``fp``) that have the
    same components as all pairs within ``radius`` bits."""

    send_code(prints.sparkSession)

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def forest(buckets: pd.Series) -> pd.Series:
        return pd.Series([
            [{"a": a, "b": b} for a, b in spanning_forest(np.sort(np.asarray(x, np.int64)).view(np.uint64), radius)]
            for x in buckets
        ])

    mask_type = "bigint"
    members, found, level = prints.select("fp", F.lit(0).cast(mask_type).alias("mask")), [], 0
    while True:
        masks = F.array(*(F.lit(m).cast(mask_type) for m in covering_masks(radius, level)))
        keyed = (
            members.select("fp", "mask", F.explode(masks).alias("more"))
            .select("fp", F.col("mask").bitwiseOR(F.col("more")).alias("mask"))
            .distinct()
            .withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        )
        buckets = (
            keyed.groupBy("mask", "key")
            .agg(
                F.count("*").alias("n"),
                F.min("fp").alias("low"),
                F.max("fp").alias("high"),
                F.bit_count(F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))).alias("spread"),
            )
            .where("n > 1")
        )
        buckets = written(buckets, "buckets")
        found.append(
            buckets.where((F.col("n") == 2) & (F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= radius)).select(
                F.col("high").alias("a"), F.col("low").alias("b")
            )
        )
        crowded = keyed.join(buckets.where("n > 2"), ["mask", "key"])
        found.append(
            crowded.where((F.col("spread") <= radius) & (F.col("fp") != F.col("low"))).select(
                F.col("fp").alias("a"), F.col("low").alias("b")
            )
        )
        loose = crowded.where(F.col("spread") > radius)
        found.append(
            loose.where(F.col("n") <= bucket_limit)
            .groupBy("mask", "key")
            .agg(F.collect_list("fp").alias("members"))
            .select(F.explode(forest("members")).alias("e"))
            .select("e.a", "e.b")
        )
        if buckets.where((F.col("n") > bucket_limit) & (F.col("spread") > radius)).isEmpty():
            break
        members = written(loose.where(F.col("n") > bucket_limit).select("fp", "mask"), "hot")
        level += 1
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def near_duplicates(
    docs: DataFrame,
    keys: list[str],
    text: str = "text",
    order: str = "doc_id",
    shingle: int = 3,
    radius: int = 3,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """One row per row of ``docs``: the ``keys`` columns, ``fp``, ``root`` (the
    component's smallest fingerprint) and its smallest ``order`` value as ``component_id``.

    Texts without a word have fingerprint 0 and are linked like any other. Rows
    with a null ``order`` value take part, but are a component's id only as null,
    when it has no other. Repeated rows give repeated rows. Fingerprints are
    written to the shared folder once; equal ones are made one before the search.
    """
    columns = [F.col(k) for k in dict.fromkeys([*keys, order])]
    prints = written(docs.select(*columns, fingerprints(docs, text, shingle).alias("fp")), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min(order).alias("least"))
    roots = components(links(classes.select("fp"), radius, bucket_limit), "a", "b")
    known = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    known = written(known, "classes")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select(*keys, "fp", "root", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
