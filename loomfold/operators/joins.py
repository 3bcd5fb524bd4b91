"""Joins on keys. Hints are left to the optimizer, which knows the sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_done(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't done; rows with a null key stay."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def chained_sampling(sources: list[DataFrame], done: DataFrame, key: str = "id") -> list[DataFrame]:
    """Each source without what is done or what an earlier source has; repeats within a source stay."""
    out = []
    for s in sources:
        out.append(not_done(s, done, key))
        done = done.select(key).unionByName(s.select(key))
    return out


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last in order."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, F.col(order)).alias("row")).select("row.*")


def with_metadata(rows: DataFrame, meta: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join with the latest metadata of each key."""
    return rows.join(latest(meta, key, order).drop(order), key)


def lookup(rows: DataFrame, found: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """Left join of one value with a default for what is missing."""
    return rows.join(found.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def apply_repairs(log: DataFrame, repairs: DataFrame, key: str = "unit_id", wrong: str = r"^\s*Wait\b") -> DataFrame:
    """The log with repaired text: a substitution goes before a new text; flags say what happened."""
    own = repairs.select(key, F.col("substitute"), F.col("retranslated"))
    joined = log.join(own, key, "left")
    fixed = F.coalesce("substitute", "retranslated", "hi")
    return joined.withColumn("exhausted", F.when(F.col("substitute").isNotNull() | F.col("retranslated").isNotNull(), False).otherwise(F.col("exhausted"))).withColumn("repaired", F.col("substitute").isNotNull() | F.col("retranslated").isNotNull()).withColumn("hi", fixed).drop("substitute", "retranslated")


def document_of(unit_id: str = "unit_id"):
    """The document's part of a unit id."""
    return F.regexp_extract(unit_id, "(?s)^(.*):[^:]*$", 1)


def resumable(jobs: DataFrame, examples: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Examples of submitted jobs that aren't done."""
    ids = jobs.where("status = 'submitted'").select(F.explode("problem_ids").alias(key))
    return not_done(only(examples, ids, key), done, key)
