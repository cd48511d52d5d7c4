"""Stable buckets: the same row lands in the same bucket on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 from the md5 of the key's text (null stays null)."""
    head = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(buckets))
