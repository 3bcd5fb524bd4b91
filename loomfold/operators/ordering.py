"""Places and quantiles in the order of a whole table, without a task that sees all of it.

Values are dealt to ranges between approximate percentiles. Counts of the ranges are exact, so what is made of them is.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import bind


def cut_points(df: DataFrame, value: str, ranges: int) -> list:
    """Ascending values that cut the column, nulls left out, into about so many even ranges; a frequent value comes several times."""
    if ranges < 2:
        return []
    return df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000).alias("c")).first()["c"] or []


def range_of(value: Column, cuts: list) -> Column:
    """How many of the distinct cuts are below the value; -1 for null. Cuts are looked through in two levels."""
    own = sorted(set(cuts))
    if not own:
        return F.when(value.isNull(), -1).otherwise(0)
    width = max(1, int(len(own) ** 0.5))
    parts = [own[i : i + width] for i in range(0, len(own), width)]
    below = lambda held: F.size(F.filter(held, lambda c: c < value))
    coarse = below(F.array(*[F.lit(p[-1]) for p in parts]))  # parts that are below as a whole
    fine = F.array(*[F.array(*[F.lit(c) for c in p]) for p in parts])
    inside = lambda k: F.least(k * width, F.lit(len(own))) + F.greatest(below(F.get(fine, k)), F.lit(0))
    return F.when(value.isNull(), -1).otherwise(bind(coarse, lambda k: F.coalesce(inside(k), F.lit(len(own)))))


def summed(df: DataFrame, order: str, name: str, weight: Column | None = None, ranges: int | None = None, tie: str | None = None) -> tuple[DataFrame, int]:
    """``df`` with the sum of whole, not negative weights (1 by default) up to and with each row in the order of a numeric column, and the sum of all.

    Each range is summed by its own task and moved by the sums of the ranges before. Nulls come first. Rows that share a
    value are ordered by ``tie``, a numeric column, or by a hash of the whole row; a frequent value, or null, is cut by that
    as well, so its rows don't meet in one task either. Rows that share both come in some order.
    """
    n = ranges or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    flat = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    own = df.withColumn("_tie", F.col(tie) if tie else F.xxhash64(*flat)).withColumn("_weight", F.lit(1) if weight is None else weight)
    cuts = cut_points(own, order, n)
    frequent = [v for v, same in groupby(cuts) if len(list(same)) > 1]
    part = range_of(F.col(order), cuts)
    heavy = own.where(F.col(order).isin(frequent) | F.col(order).isNull()) if frequent else own.where(F.col(order).isNull())
    within = heavy.groupBy(order).agg(F.percentile_approx("_tie", [i / n for i in range(1, n)], 10_000).alias("c")).collect() if n > 1 else []  # a row for each frequent value
    known = {r[order]: sorted(set(r["c"])) for r in within if r["c"]}
    empty = F.array().cast("array<bigint>")
    of_null = F.array(*[F.lit(c) for c in known.pop(None)]) if None in known else empty
    of_value = F.element_at(F.create_map(*[x for v, c in known.items() for x in (F.lit(v), F.array(*[F.lit(y) for y in c]))]), F.col(order)) if known else empty
    below = F.coalesce(F.size(F.filter(F.when(F.col(order).isNull(), of_null).otherwise(of_value), lambda c: c < F.col("_tie"))), F.lit(0))
    placed = own.withColumn("_range", part).withColumn("_sub", F.greatest(below, F.lit(0)))
    sums = {(r["_range"], r["_sub"]): r["s"] for r in placed.groupBy("_range", "_sub").agg(F.sum("_weight").alias("s")).collect()}  # at most two rows for each range
    before, at = [], 0
    for k in sorted(sums):
        before.append((k, at))
        at += sums[k]
    key = F.concat_ws("/", F.col("_range").cast("string"), F.col("_sub").cast("string"))
    offsets = F.create_map(*[x for (a, b), v in before for x in (F.lit(f"{a}/{b}"), F.lit(v).cast("long"))]) if before else F.lit(None).cast("map<string,bigint>")
    w = Window.partitionBy("_range", "_sub").orderBy(order, "_tie")
    upto = F.row_number().over(w) if weight is None else F.sum("_weight").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn(name, upto + F.element_at(offsets, key)).drop("_range", "_sub", "_tie", "_weight"), at


def ranked(df: DataFrame, order: str, name: str = "rank", ranges: int | None = None, tie: str | None = None) -> tuple[DataFrame, int]:
    """``df`` with the place of each row from 1 in the order of :func:`summed`, and the number of rows."""
    return summed(df, order, name, None, ranges, tie)


def values_at(df: DataFrame, value: str, ranks: list[int], cuts: list | None = None, ranges: int = 256) -> dict[int, object]:
    """The values at ranks from 1 in the ascending order of a column without nulls.

    Three passes whatever the ranks: cuts (unless they are given), counts of ranges, and the distinct values with their counts in
    the ranges that hold a rank, each range walked on its own.
    """
    cuts = cut_points(df, value, ranges) if cuts is None else cuts
    placed = df.select(F.col(value).alias("v"), range_of(F.col(value), cuts).alias("k"))
    counts = {r["k"]: r["count"] for r in placed.groupBy("k").count().collect()}  # a row for each range
    wanted, at = [], 0
    for k in sorted(counts):
        wanted += [(k, r, r - at) for r in ranks if at < r <= at + counts[k]]
        at += counts[k]
    if not wanted:
        return {}
    upto = F.sum("c").over(Window.partitionBy("k").orderBy("v"))
    walked = placed.where(F.col("k").isin(sorted({k for k, _, _ in wanted}))).groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", upto)
    found = walked.groupBy("k").agg(*[F.min(F.when((F.col("k") == k) & (F.col("upto") >= own), F.col("v"))).alias(str(r)) for k, r, own in wanted]).collect()
    return {r: next(x[str(r)] for x in found if x["k"] == k) for k, r, _ in wanted}
