"""Incremental runs: file streams, idempotent appends, resume, quarantine, and outside services."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, path: str, schema: str, stream: bool, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """The same rows as a batch or as a stream."""
    if not stream:
        return spark.read.schema(schema).format(kind).load(path)
    r = spark.readStream.schema(schema).format(kind)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).load(path)


def fits(df: DataFrame, most: int, how: str = "filter") -> DataFrame:
    """Rows of at most ``most`` ids; or, for ``right``, rows whose prompt fits, cut to that. The same on streams."""
    if how == "filter":
        return df.where(F.size("input_ids") <= most)
    own = df.where(F.col("prompt_len") <= most) if "prompt_len" in df.columns else df  # a row without a length goes
    return own.withColumns({c: F.slice(c, 1, most) for c in ("input_ids", "labels") if c in df.columns})


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append rows with new keys, of those that share one any one; a run that is begun again goes on where it stopped.

    What was written isn't read again: keys are the stream's state, dealt by key and kept in RocksDB, and the sink's log knows
    its batches, so a batch that is run twice adds nothing, and a batch's work doesn't grow with the target. A target goes with the
    checkpoint that it was begun with.
    """
    spark = stream.sparkSession
    jvm = spark.sparkContext._jvm
    there = lambda path: (p := jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    if there(target) and not there(f"{checkpoint}/offsets"):
        raise ValueError(f"{target} was begun with another checkpoint than {checkpoint}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.dropDuplicates([key]).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Ranks(StatefulProcessor):
    """Numbers the rows of a group in the order in which its batches come, and within a batch by a column."""

    def __init__(self, columns: list[str], order: str, skip: int, take: int):
        self.columns, self.order, self.skip, self.take = columns, order, skip, take

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timers):
        n = self.count.get()[0] if self.count.exists() else 0
        first, last = max(0, self.skip - n), max(0, self.skip + self.take - n)
        held = None
        for f in rows:  # only the rows that may be given are held
            n += len(f)
            held = (f if held is None else pd.concat([held, f])).sort_values(self.order, kind="stable").head(last)
        self.count.update((n,))
        if first < last and held is not None and len(held) > first:
            yield held.iloc[first:][self.columns]

    def close(self) -> None:
        pass


def take_after(df: DataFrame, group: str, order: str, skip: int, take: int) -> DataFrame:
    """Of each group ``take`` rows after the first ``skip``, in a stream as in a batch.

    A stream keeps a counter for each group, nothing else: the rows of a trigger are ordered by ``order`` and go after those of the
    triggers before. So stream and batch give the same rows where ``order`` grows from trigger to trigger.
    """
    if not df.isStreaming:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
        return df.withColumn("_rank", rank).where(F.col("_rank").between(skip + 1, skip + take)).drop("_rank")
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df.groupBy(group).transformWithStateInPandas(_Ranks(df.columns, order, skip, take), df.schema, "append", "none")


def windowed_counts(stream: DataFrame, time_column: str, late: str, width: str, by: str) -> DataFrame:
    """Rows in windows of event time; rows later than the watermark are left out."""
    return stream.withWatermark(time_column, late).groupBy(F.window(time_column, width), by).agg(F.count(F.lit(1)).alias("n"))


def last_versions(log: DataFrame, key: str, order: str) -> DataFrame:
    """An append-only log with one row for each key, the last written."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.col(order)).alias("row")).select("row.*")


def quarantine(df: DataFrame, work: Callable, result: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a column function that gives a struct of value and error, run once on each row."""
    done = df.withColumn("_done", work)
    good = done.where("_done.error is null").withColumn(result, F.col("_done.value")).drop("_done")
    return good, done.where("_done.error is not null").withColumn("error", F.col("_done.error")).drop("_done")


def guarded(function: Callable[[str], str]):
    """A UDF that gives the value or the error as text, so one bad document doesn't end a run."""

    @F.pandas_udf("struct<value:string,error:string>")
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((function(v), None))
            except Exception as e:  # noqa: BLE001 - any error of the document's own is its result
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return run


def call_with_retries(call: Callable[[list[str]], list[float]], texts: list[str], tries: int = 3, wait: float = 1.0) -> list[float]:
    """The service's answer, tried again after 1, 2, 4 ... waits."""
    for n in range(tries):
        try:
            return call(texts)
        except Exception:
            if n + 1 == tries:
                raise
            time.sleep(wait * 2**n)
    raise ValueError("no tries")


def score_remotely(df: DataFrame, column: str, connect: Callable[[], Callable[[list[str]], list[float]]], batch: int = 64) -> DataFrame:
    """``score`` from a service: one connection for each task, requests of a bounded size. Nothing calls a service by default."""
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = connect()
        for f in frames:
            scores: list[float] = []
            for at in range(0, len(f), batch):
                scores += call_with_retries(call, f[column].iloc[at : at + batch].tolist())
            yield f.assign(score=scores)[[*names, "score"]]

    return df.mapInPandas(run, f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, score double")


def attempts(df: DataFrame, generate: Callable[[str, float], str], check: Callable[[str, str], str | None], most: int = 3) -> DataFrame:
    """Bounded retries for each unit (unit_id, text): temperature 0, then 0.7; the last bad attempt is kept, a used-up unit has no result."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for unit, text in zip(f["unit_id"], f["text"], strict=True):
                bad, good, n = None, None, 0
                for n in range(most + 1):
                    got = generate(text, 0.0 if n == 0 else 0.7)
                    if check(text, got) is None:
                        good = got
                        break
                    bad = got
                rows.append((unit, good, n, bad is not None, good is None, bad))
            yield pd.DataFrame(rows, columns=["unit_id", "hi", "retries", "had_defect", "exhausted", "erroneous"])

    return df.select("unit_id", "text").mapInPandas(run, "unit_id string, hi string, retries int, had_defect boolean, exhausted boolean, erroneous string")


def load_function(path: str) -> Callable:
    """A function by its dotted path."""
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


class Registry:
    """Things by name, in any case."""

    def __init__(self) -> None:
        self._things: dict[str, object] = {}

    def add(self, name: str, thing: object) -> None:
        self._things[name.lower()] = thing

    def get(self, name: str) -> object:
        if name.lower() not in self._things:
            raise ValueError(f"unknown name {name!r}; known: {', '.join(sorted(self._things))}")
        return self._things[name.lower()]
