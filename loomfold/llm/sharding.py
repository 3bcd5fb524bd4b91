"""Sharding by histogram sort, with DataFrame operations only.

Every row has a sort key of three non-negative 62-bit numbers: a hash of the text, a hash of the id, and a row number.
The driver keeps, for each of the ``shards - 1`` boundaries, an interval of keys that must hold it. A round counts the
exact bytes and rows between evenly spaced probes of all open intervals over all partitions; an interval shrinks to the
gap between the two probes around its target until a probe is within ``tolerance`` of it. Probes on the first number
never cut a group of equal texts, so groups stay whole wherever the tolerance lets them, and a group larger than that is
cut along the second and third number. What reaches the driver is at most ``shards * fanout`` counts a round. The rows
are exchanged once, afterwards, by shard and sub-bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

KEYS = ("k1", "k2", "k3")
SPAN = 1 << 62


def byte_size(text: Column, overhead: int = 16) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long")


def sort_keys(text: Column, row_id: Column) -> list[Column]:
    """The three parts of the sort key; equal texts share the first."""
    return [
        F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2).alias("k1"),
        F.shiftrightunsigned(F.xxhash64(row_id), 2).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
    ]


@dataclass
class _Gap:
    """Keys that start with ``prefix`` and go on with a number from ``lo`` to below ``hi``."""

    prefix: tuple[int, ...]
    lo: int
    hi: int
    below: int
    targets: list[float] = field(default_factory=list)

    def holds(self) -> Column:
        own = [F.col(k) == F.lit(v) for k, v in zip(KEYS, self.prefix, strict=False)]
        key = F.col(KEYS[len(self.prefix)])
        own += [key >= F.lit(self.lo), key < F.lit(self.hi)]
        out = own[0]
        for c in own[1:]:
            out = out & c
        return out


def find_splitters(keyed: DataFrame, shards: int, tolerance: float = 0.005, fanout: int = 256) -> list[tuple[int, int, int]]:
    """The ``shards - 1`` keys at which shards begin. ``keyed`` has k1, k2, k3 and ``size``.

    An empty table gives splitters that no row reaches. Targets that one indivisible row straddles are put on the side
    nearer to them. ``tolerance`` is a share of the mean shard.
    """
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    allowed = tolerance * total / shards
    found: dict[float, tuple[int, int, int]] = {}
    targets = [total * j / shards for j in range(1, shards)]
    open_gaps = [_Gap((), 0, SPAN, 0, targets)] if total else []
    first = True
    while open_gaps:
        probes = 4096 if first else fanout
        first = False
        place = F
        for i, g in enumerate(open_gaps):
            width = -(-(g.hi - g.lo) // probes)
            bucket = F.expr(f"({KEYS[len(g.prefix)]} - {g.lo}L) div {width}L")
            place = place.when(g.holds(), F.struct(F.lit(i).alias("gap"), bucket.alias("bucket")))
        counted = (
            keyed.select(place.alias("place"), "size")
            .where(F.col("place").isNotNull())
            .groupBy("place.gap", "place.bucket")
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        )
        by_gap: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counted.collect():  # at most shards * probes counts
            by_gap.setdefault(r["gap"], {})[r["bucket"]] = (r["bytes"], r["rows"])
        narrower: dict[tuple, _Gap] = {}
        for i, g in enumerate(open_gaps):
            width = -(-(g.hi - g.lo) // probes)
            run, waiting = g.below, sorted(g.targets)
            for b in sorted(by_gap.get(i, {})):
                size, rows = by_gap[i][b]
                start, end = g.lo + b * width, min(g.lo + (b + 1) * width, g.hi)
                while waiting and waiting[0] <= run + size:
                    t = waiting.pop(0)
                    low, high = t - run, run + size - t
                    last = len(g.prefix) == len(KEYS) - 1 and end - start == 1
                    if min(low, high) <= allowed or rows == 1 or last:
                        at = start if low <= high else end
                        found[t] = (*g.prefix, at, *[0] * (len(KEYS) - 1 - len(g.prefix)))
                        continue
                    inner = _Gap((*g.prefix, start), 0, SPAN, run) if end - start == 1 else _Gap(g.prefix, start, end, run)
                    narrower.setdefault((inner.prefix, inner.lo, inner.hi), inner).targets.append(t)
                run += size
            for t in waiting:
                found[t] = (*g.prefix, g.hi, *[0] * (len(KEYS) - 1 - len(g.prefix)))
        open_gaps = list(narrower.values())
    return sorted(found.get(t, (SPAN, 0, 0)) for t in targets)


def shard_of(splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at or below the key of the row."""
    out = F.lit(0)
    for a, b, c in splitters:
        k1, k2, k3 = (F.col(k) for k in KEYS)
        reached = (k1 > F.lit(a)) | ((k1 == F.lit(a)) & ((k2 > F.lit(b)) | ((k2 == F.lit(b)) & (k3 >= F.lit(c)))))
        out = out + reached.cast("int")
    return out


def with_slots(sharded: DataFrame, rows: int, shards: int, rows_per_task: int = 20_000) -> DataFrame:
    """Gapless numbers from 0 within each shard.

    A shard of more than ``rows_per_task`` rows is numbered in sub-buckets, each by its own task, from offsets that
    come from the sub-buckets' counts; so no task sorts a whole shard.
    """
    subs = max(1, -(-rows // (shards * rows_per_task)))
    df = sharded.withColumn("sub", F.pmod(F.xxhash64("k2", "k3"), F.lit(subs)).cast("int"))
    own = F.row_number().over(Window.partitionBy("shard", "sub").orderBy(*KEYS)).cast("long") - F.lit(1)
    if subs == 1:
        return df.withColumn("slot", own).drop("sub")
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n")).select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return df.withColumn("own", own).join(offsets, ["shard", "sub"]).withColumn("slot", F.col("own") + F.col("offset")).drop("own", "offset", "sub")


def histogram_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.005, text: str = "text", doc_id: str = "doc_id", overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    Null texts count as empty, null ids are a key like any other, repeated rows are separate rows (of equal texts the ids' hashes,
    then the row numbers, decide), a row larger than a shard's target is a shard of its own or nearly so, an empty table
    gives an empty result, and further columns of ``docs`` are never read. Texts are read once, for their hash and size.
    """
    body = F.col(text)
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        byte_size(body, overhead).alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        *sort_keys(body, F.col(doc_id)),
    )
    slim = materialize(slim, "shard-keys")
    splitters = find_splitters(slim, shards, tolerance)
    out = slim.withColumn("shard", shard_of(splitters))
    return with_slots(out, slim.count(), shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def op7_histogram_shards(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return histogram_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
