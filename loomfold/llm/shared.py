"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where the session names none, one is set: a temporary folder if Spark runs in this process alone (tests), else one below
    the warehouse, which driver and executors share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = tempfile.mkdtemp(prefix="loomfold-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/loomfold-scratch"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/loomfold-{tag}-{uuid.uuid4().hex}"
    atexit.register(_quietly, spark, path)
    return path


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # noqa: BLE001 - the JVM may be gone by then
        pass


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and broadcasts of finished jobs now: it does so when the driver collects its garbage, by default each half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_results: list[list[str]] = []


@contextmanager
def until_written(spark: SparkSession):
    """Tables that operators keep for their results are deleted when the block ends: what is made in it is to be written in it."""
    own: list[str] = []
    _results.append(own)
    try:
        yield
    finally:
        _results.remove(own)
        for path in own:
            delete_path(spark, path)


class Scratch:
    """The scratch tables of one operator, by name. Leaving the block deletes all but those kept.

    What an operator returns may read kept tables only; they last until the application ends, or until the end of the
    :func:`until_written` that is open.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.free(*list(self.paths))
        release(self.spark)

    def table(self, df: DataFrame, name: str, keep: bool = False, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` to the shared folder and read it again: lineage is cut and a lost executor loses nothing."""
        path = scratch_path(self.spark, name)
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        if not keep:
            self.paths.setdefault(name, []).append(path)
        elif _results:
            _results[-1].append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        """Delete tables whose last reader has been written."""
        for name in names:
            for path in self.paths.pop(name, []):
                delete_path(self.spark, path)


def materialize(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """A scratch table that lasts until the application ends."""
    return Scratch(df.sparkSession).table(df, tag, keep=True, partition_by=partition_by)


def broadcast_if_small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df``, whose rows are narrow, with a hint to broadcast it if they are few."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of texts small from now on in this session: their bytes are held by the JVM and by Python.

    It can't be set back by an operator, as its result is read later, under the settings of that time.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))
