"""Sinks: JSON lines and Parquet, routed, pruned, with counts and cards."""

from __future__ import annotations

import atexit
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share, ``spark.checkpoint.dir`` or else the warehouse; what is there when the application ends is deleted."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/loomfold-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone by then
        pass


def append_json(df: DataFrame, path: str) -> None:
    """Each task appends its own file, so no lock is needed."""
    df.write.mode("append").json(path)


def overwrite_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_outcomes(made: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents that were made and the faults of those that weren't (see ``reconstruct_checked``), written by one job into a folder each; gives both."""
    made.withColumn("outcome", F.when(F.size("failures") == 0, "made").otherwise("failed")).write.mode("overwrite").partitionBy("outcome").parquet(path)
    both = made.sparkSession.read.schema(made.schema.add("outcome", "string")).parquet(path)
    failed = both.where("outcome = 'failed'").select("doc_id", F.inline("failures"))
    return both.where("outcome = 'made'").select("doc_id", "text"), failed


def flagged_report(df: DataFrame, order: list[str], most: int) -> str:
    """The first rows as a JSON array with indents."""
    rows = df.orderBy(*order).limit(most).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).collect()  # bounded by most
    return json.dumps([json.loads(r["j"]) for r in rows], indent=2, ensure_ascii=False)


def kept_steps(df: DataFrame, least: int) -> DataFrame:
    """Documents with their usable steps; those without any are left out."""
    good = lambda s: ~F.coalesce(s["has_missing_translation"], F.lit(False)) & (s["en"] != "") & (s["hi"] != "") & (F.coalesce(s["token_count"], F.lit(0)) >= least)
    own = df.withColumn("steps", F.filter("steps", good)).where(F.size("steps") > 0)
    return own.select(F.col("doc_id").alias("id"), F.transform("steps", lambda s: F.struct(s["en"].alias("en"), s["hi"].alias("hi"))).alias("steps"))


def write_kept(df: DataFrame, path: str, least: int) -> tuple[int, int]:
    """Write :func:`kept_steps`; gives the numbers of documents and steps."""
    kept_steps(df, least).write.mode("overwrite").json(path)
    row = df.sparkSession.read.schema("id string, steps array<struct<en:string,hi:string>>").json(path).agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum(F.size("steps")), F.lit(0)).alias("s")).first()
    return row["d"], row["s"]


def tokenized_path(base: str, max_length: int, insert_eos: bool, drop_tail: bool) -> str:
    """A folder that names its settings."""
    return f"{base}/max_length-{max_length}-insert_eos-{insert_eos}-drop_tail-{drop_tail}"


def write_tokenized(df: DataFrame, path: str, keep: tuple[str, ...] = ("input_ids", "labels", "prompt_len", "attention_mask")) -> None:
    """Only the columns that training reads."""
    df.select(*[c for c in keep if c in df.columns]).write.mode("overwrite").parquet(path)


def dataset_card(title: str, counts: list[tuple[str | None, int, int]]) -> str:
    """A markdown card with a table of documents and steps by source; a null source is the total."""
    lines = [f"# {title}", "", "| source | documents | steps |", "| --- | ---: | ---: |"]
    lines += [f"| {s or 'Total'} | {d:,} | {n:,} |" for s, d, n in sorted(counts, key=lambda x: (x[0] is None, x[0] or ""))]
    return "\n".join(lines) + "\n"


def publish(df: DataFrame, path: str, title: str) -> str:
    """Parquet and its card's text."""
    df.write.mode("overwrite").parquet(path)
    by = df.rollup("source").agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("num_steps"), F.lit(0)).alias("n"))
    return dataset_card(title, [(r["source"], r["d"], r["n"]) for r in by.collect()])  # one row for each source


def update_ledger(df: DataFrame, path: str, changes: DataFrame) -> None:
    """Append new versions of rows; :func:`read_ledger` takes the latest."""
    changes.withColumn("version", F.current_timestamp()).write.mode("append").parquet(path)


def read_ledger(df: DataFrame, key: str = "batch_id") -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), "version").alias("row")).select("row.*")


def write_results(df: DataFrame, path: str, step: int, score: str = "reward") -> dict:
    """Append each result as it comes, and a summary row of their mean once all are there; gives the summary."""
    df.withColumn("step", F.lit(step)).write.mode("append").json(f"{path}/results")
    written = df.sparkSession.read.json(f"{path}/results").where(F.col("step") == step)
    summary = written.groupBy("step").agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"))
    summary.write.mode("append").json(f"{path}/summary")
    return summary.first().asDict()

