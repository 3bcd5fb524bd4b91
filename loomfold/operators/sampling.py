"""Samples, splits, limits and unions that give the same rows however the data are partitioned."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import in_validation, seeded_order
from .ordering import ranked


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, those with the lowest md5 of seed and key; the same in any system that has md5."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def shards_of(spark: SparkSession, path: str, name: str) -> dict[str, list[str]]:
    """The files of a Parquet table by shard: the part of the path that the pattern finds below the table's folder."""
    out: dict[str, list[str]] = {}
    for file in spark.read.parquet(path).inputFiles():
        found = re.search(name, file[file.find(path.split(":")[-1]) + len(path.split(":")[-1]) :])
        out.setdefault(found[0] if found else file.rsplit("/", 1)[-1], []).append(file)
    return out


def sample_shards(spark: SparkSession, path: str, n: int, rows_per_shard: int, seed: int = 0, name: str = r"part-\d+") -> DataFrame:
    """n rows without replacement (all, if fewer) from a few shards of a Parquet table, with ``shard`` and ``row_index`` besides.

    As many shards are drawn as n rows need, and two more; they are those with the lowest hashes of seed and shard. Only their
    files are read. Rows are those with the lowest hashes of seed, shard and place in the file, so a draw can be had again from the
    same files, and files elsewhere in the table change nothing in it. Files of one shard count as one if each row index is in one of them.
    """
    shards = shards_of(spark, path, name)
    few = min(len(shards), max(1, n // rows_per_shard + 2))
    drawn = sorted(shards, key=lambda s: (hashlib.md5(f"{seed}:{s}".encode()).hexdigest(), s))[:few]
    rows = spark.read.option("basePath", path).parquet(*[f for s in drawn for f in shards[s]])
    shard = F.regexp_extract("_metadata.file_path", name, 0)
    own = rows.withColumns({"shard": shard, "row_index": F.col("_metadata.row_index")})
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "shard", F.col("row_index").cast("string")).cast("binary"))
    return own.orderBy(order, "shard", "row_index").limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(seeded_order(F.col(key), seed), key)


def hash_split(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """``split``: validation or train by the md5 rule on the key as text."""
    return df.withColumn("split", F.when(in_validation(F.col(key).cast("string"), fraction), "validation").otherwise("train"))


def head_split(df: DataFrame, order: str, fraction: float) -> DataFrame:
    """``split``: the first ``max(1, n * fraction)`` rows are eval (none for a fraction of 0), the others train."""
    rows, n = ranked(df, order, "_rank")
    take = max(1, int(n * fraction)) if fraction > 0 else 0
    return rows.withColumn("split", F.when(F.col("_rank") <= take, "eval").otherwise("train")).drop("_rank")


def ratio_split(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """``split``: the share of rows with the lowest hashes of the key is test, the others train; the size is exact but for equal hashes."""
    rows, n = ranked(df.withColumn("_hash", seeded_order(F.col(key), seed)), "_hash", "_rank")
    return rows.withColumn("split", F.when(F.col("_rank") <= round(n * fraction), "test").otherwise("train")).drop("_rank", "_hash")


def external_split(train: DataFrame, held: DataFrame | None, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """``split`` from a held-out table (its rows are eval and leave the training rows) or, without one, :func:`ratio_split`."""
    if held is None:
        return ratio_split(train, key, fraction, seed)
    rest = train.join(held.select(key).distinct(), key, "left_anti")
    return rest.withColumn("split", F.lit("train")).unionByName(held.withColumn("split", F.lit("eval")), allowMissingColumns=True)


def rename_splits(splits: dict[str, DataFrame], names: dict[str, str]) -> dict[str, DataFrame]:
    """Splits under other names; those without one keep theirs."""
    return {names.get(k, k): df for k, df in splits.items()}


def bottom(df: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(score, tie).limit(n)


def limit_splits(splits: dict[str, DataFrame], limits: dict[str, int], order: str, overlap: bool = False) -> dict[str, DataFrame]:
    """At most so many rows of each split. A single split serves all names: test first, then train, or all from the top if ``overlap``."""
    if len(splits) > 1 or overlap:
        only = next(iter(splits.values()))
        named = {k: splits.get(k, only) for k in limits} if len(splits) == 1 else splits
        return {k: df.orderBy(order).limit(limits[k]) if k in limits else df for k, df in named.items()}
    if not limits:
        return splits
    ((_, df),) = splits.items()
    (rows, _), out, at = ranked(df, order, "_rank"), {}, 0
    for k in sorted(limits, key=lambda k: k != "test"):
        out[k] = rows.where(F.col("_rank").between(at + 1, at + limits[k])).drop("_rank")
        at += limits[k]
    return out


def merge_splits(parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Splits of the same name appended in order; others pass through."""
    names = dict.fromkeys(k for p in parts for k in p)
    return {k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p[k] for p in parts if k in p]) for k in names}


def repeated(df: DataFrame, epochs: int) -> DataFrame:
    """Each row once in each epoch."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def slices(df: DataFrame, order: str, size: int) -> DataFrame:
    """``slice``: numbers of consecutive pieces of a size."""
    rows, _ = ranked(df, order, "_rank")
    return rows.withColumn("slice", F.floor((F.col("_rank") - 1) / size).cast("int")).drop("_rank")


def length_buckets(df: DataFrame, length: str, size: int) -> DataFrame:
    """``bucket``: batches of a size among rows of like length."""
    return slices(df, length, size).withColumnRenamed("slice", "bucket")


def streams_together(streams: list[DataFrame]) -> DataFrame:
    """Streams, or tables, of one schema as one; their rows come in no order of streams."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
