"""Sampling and splits that depend on keys only, so partitions and retries don't change them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_mod(text: Column, modulus: int) -> Column:
    """The md5 read as a 128-bit number, modulo ``modulus`` (under 2 ** 20): the two halves are reduced apart."""
    digest = F.md5(F.encode(text, "UTF-8"))
    half = lambda start: F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)")
    rest = lambda x: F.pmod(x, F.lit(modulus).cast("decimal(20,0)")).cast("long")
    return F.pmod(rest(half(1)) * F.lit((1 << 64) % modulus) + rest(half(17)), F.lit(modulus))


def in_validation(doc_id: Column, fraction: float) -> Column:
    """The deterministic split: md5 of ``split:<id>`` modulo 10000 below the fraction."""
    return md5_mod(F.concat(F.lit("split:"), doc_id), 10_000) < F.lit(int(fraction * 10_000))


def seeded_order(key: Column, seed: int) -> Column:
    """A pseudo-random sort key of the row's key."""
    return F.xxhash64(key, F.lit(seed))


def shards_needed(sample: int, rows: int, rows_per_shard: int, shards: int) -> int:
    """How many shards to read for a two-stage sample."""
    return min(shards, max(1, min(sample, rows) // rows_per_shard + 2))
