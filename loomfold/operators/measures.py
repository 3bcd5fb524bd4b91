"""Group statistics, advantages, weighted means and quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import summed, values_at


def source_totals(docs: DataFrame, source: str, steps: Column) -> DataFrame:
    """Documents and steps by source, with a row for all (source null)."""
    return docs.rollup(source).agg(F.count(F.lit(1)).alias("docs"), F.sum(steps).alias("steps"))


def index_quantiles(df: DataFrame, value: str, at: dict[str, tuple[int, int]], ranges: int = 256) -> DataFrame:
    """Values at ranks ``n * a // b`` of the ascending order, null for an empty table; count, min and max besides.

    All ranks are found together by exact counts of ranges, in as many passes whatever their number.
    """
    own = df.where(F.col(value).isNotNull()).select(value)
    cuts = F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000).alias("cuts")
    row = own.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), cuts).first()
    ranks = {name: row["n"] * a // b + 1 for name, (a, b) in at.items()}
    found = values_at(own, value, sorted(set(ranks.values())), row["cuts"]) if row["n"] else {}
    kind = df.schema[value].dataType
    return df.sparkSession.range(1).select(F.lit(row["n"]).cast("long").alias("n"), *[F.lit(row[c]).cast(kind).alias(c) for c in ("least", "most")], *[F.lit(found.get(r)).cast(kind).alias(name) for name, r in ranks.items()])


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """``mean`` and ``perplexity`` (its exponential)."""
    mean = F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))
    return df.groupBy(*(by or [])).agg(mean.alias("mean")).withColumn("perplexity", F.exp("mean"))


def total_reward(weights: dict[str, float]) -> Column:
    """Weighted sum over reward columns; null and NaN count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)) * w for c, w in weights.items()])


def advantages(df: DataFrame, group: str, reward: str, scale: bool = False) -> DataFrame:
    """``advantage``: reward less its group's mean, over the group's deviation on request (one member counts as 0)."""
    w = Window.partitionBy(group)
    own = F.col(reward) - F.avg(reward).over(w)
    return df.withColumn("advantage", own / (F.coalesce(F.stddev_samp(reward).over(w), F.lit(0.0)) + 1e-4) if scale else own)


def flat_groups(df: DataFrame, group: str, reward: str, tolerance: float = 1e-8) -> DataFrame:
    """The share of groups whose rewards don't differ."""
    g = df.groupBy(group).agg(F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("s"))
    return g.agg(F.avg((F.col("s") <= tolerance).cast("int")).alias("flat_share"))


def loss(df: DataFrame, value: str, row: str, how: str) -> DataFrame:
    """Mean over tokens, mean over rows of their means, or sum over the number of rows."""
    if how == "token":
        return df.agg(F.avg(value).alias("loss"))
    if how == "sequence":
        return df.groupBy(row).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("loss"))
    if how == "batch":
        return df.agg((F.sum(value) / F.count_distinct(row)).alias("loss"))
    raise ValueError(f"loss over {how!r}")


def pack_global(docs: DataFrame, doc_id: str, ids: str, size: int, keep_tail: bool = False) -> DataFrame:
    """All ids in the order of documents, cut into blocks of a size; the last, shorter one is kept on request.

    Offsets are running sums over documents, found from sums of document ranges, so no task walks the corpus. Documents without
    an id come first, in the order of a hash, and rows that repeat one after the other.
    """
    lengths = docs.select(F.col(doc_id).alias("d"), F.col(ids).alias("ids"), F.size(ids).alias("n")).where("n > 0")
    placed, _ = summed(lengths.withColumn("key", F.xxhash64("d", "ids")), "d", "end", F.col("n"), tie="key")
    placed = placed.withColumn("at", F.col("end") - F.col("n"))
    parts = placed.select("at", "n", "ids", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))).alias("block"))
    start = F.greatest(F.lit(0).cast("long"), F.col("block") * size - F.col("at"))
    stop = F.least(F.col("n").cast("long"), (F.col("block") + 1) * size - F.col("at"))
    cut = parts.select("block", "at", F.slice("ids", (start + 1).cast("int"), (stop - start).cast("int")).alias("piece"))
    blocks = cut.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])).alias("input_ids"))
    return blocks if keep_tail else blocks.where(F.size("input_ids") == size)


def split_metrics(df: DataFrame, split: str, metrics: dict[str, Column]) -> DataFrame:
    """One row of metrics of all splits; those of train under their names, of others after the split's name."""
    by = df.groupBy(split).agg(*[c.alias(k) for k, c in metrics.items()])
    parts = [F.create_map(F.when(F.col(split) == "train", k).otherwise(F.concat_ws("_", split, F.lit(k))), F.col(k).cast("double")).alias(k) for k in metrics]
    return by.select(F.explode(F.array(*parts)).alias("m")).select(F.explode("m").alias("metric", "value"))


def pass_ratio(df: DataFrame, by: str, passed: str) -> DataFrame:
    """The share of tests that passed. Null results count as failed."""
    return df.groupBy(by).agg((F.count_if(F.coalesce(F.col(passed), F.lit(False))) / F.count(F.lit(1))).alias("ratio"))


def trial_mean(df: DataFrame, row: str, loss: Column, weight: Column) -> DataFrame:
    """``loss``: the mean over a row's trials of its weighted losses."""
    return df.groupBy(row).agg(F.avg(loss * weight).alias("loss"))


def canvas_size(df: DataFrame, by: str, size: str, factor: float = 2.5, least: int = 16, most: int = 96) -> DataFrame:
    """``canvas``: the longest row of a group times a factor, rounded half to even, within bounds."""
    return df.groupBy(by).agg(F.greatest(F.lit(least), F.least(F.lit(most), F.bround(F.max(size) * factor).cast("int"))).alias("canvas"))


def group_crop(df: DataFrame, group: str, size: str, prompt: str, key: str, seed: int = 0) -> DataFrame:
    """``kept_len``: the response length of one row of the group, the one with the lowest hash of its key; and ``tail``, from 1 to below the shortest response (0 where that is 1 or less), by a hash of the group."""
    response = F.col(size) - F.col(prompt)
    own = df.groupBy(group).agg(F.min_by(response, F.xxhash64(key, F.lit(seed))).alias("kept_len"), F.min(response).alias("shortest"))
    tail = F.when(F.col("shortest") <= 1, 0).otherwise(1 + F.pmod(F.xxhash64(group, F.lit(seed)), F.greatest(F.col("shortest") - 1, F.lit(1))))
    return own.select(group, "kept_len", tail.cast("int").alias("tail"))
