"""Jobs and their states in a ledger that several writers share.

A transition takes a job from one state to another. Transitions are judged against the ledger's state as of a version and written
to a folder of their own; the folder becomes the next version by creating that version's commit file, which fails if another writer was
faster. The loser judges its transitions again on the new state. So each version is whole, and of two writers that want the
same job one wins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which states may follow which; None stands for a job that the ledger doesn't know.
FOLLOWS = {None: ("submitted",), "submitted": ("completed", "failed"), "failed": ("submitted",), "completed": ()}
ROW = "job_id string, status string, owner string, lease_until timestamp, at timestamp"


class Conflict(RuntimeError):
    """Other writers were faster, as often as was tried."""


def allowed(before: Column, after: Column, lapsed: Column) -> Column:
    """Whether a state may follow; a job whose lease has lapsed may be submitted again by anyone."""
    rule = F.lit(False)
    for state, next_states in FOLLOWS.items():
        if next_states:
            rule = rule | ((before.isNull() if state is None else F.coalesce(before == state, F.lit(False))) & after.isin(*next_states))
    return rule | (F.coalesce(before == "submitted", F.lit(False)) & (after == "submitted") & F.coalesce(lapsed, F.lit(False)))


class Ledger:
    """The ledger in a folder that all writers share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version, 0 for an empty ledger."""
        folder = self._at(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return 0
        return max((int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(folder)), default=0)

    def _folder(self, version: int) -> str:
        stream = self._fs.open(self._at(f"{self.path}/commits/{version:012d}.commit"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def log(self, version: int | None = None) -> DataFrame:
        """All transitions up to a version, with the version of each; a snapshot stands for what is before it."""
        parts = []
        for v in range(self.version() if version is None else version, 0, -1):
            folder = self._folder(v)
            parts.append(self.spark.read.schema(ROW).parquet(f"{self.path}/{folder}").withColumn("version", F.lit(v).cast("long")))
            if folder.startswith("snapshot"):
                break
        out = self.spark.createDataFrame([], f"{ROW}, version long")
        for p in parts:
            out = out.unionByName(p)
        return out

    def state(self, version: int | None = None) -> DataFrame:
        """A row for each job: its last transition."""
        log = self.log(version)
        return log.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "job_id"]), F.struct("version", "at")).alias("s")).select("job_id", "s.*")

    def judged(self, wanted: DataFrame, version: int) -> DataFrame:
        """Transitions (job_id, status, owner, lease_until, at) with ``before`` and ``ok``. Of several for a job the first by time, then by owner, is judged, the others are refused."""
        first = wanted.groupBy("job_id").agg(F.min(F.struct("at", "owner", "status", "lease_until")).alias("_first"))
        now = self.state(version).select("job_id", F.col("status").alias("before"), F.col("owner").alias("held_by"), F.col("lease_until").alias("held_until"))
        own = wanted.join(first, "job_id").join(now, "job_id", "left")
        is_first = (F.col("at") == F.col("_first.at")) & F.col("owner").eqNullSafe(F.col("_first.owner")) & (F.col("status") == F.col("_first.status"))
        # only who holds a job may end it
        theirs = (F.col("status") == "submitted") | F.col("held_by").eqNullSafe(F.col("owner"))
        ok = F.coalesce(is_first, F.lit(False)) & allowed(F.col("before"), F.col("status"), F.col("held_until") < F.col("at")) & theirs
        return own.withColumn("ok", ok).select("job_id", "status", "owner", "lease_until", "at", "before", "ok")

    def commit(self, rows: DataFrame, version: int, kind: str = "data") -> bool:
        """Make rows the version after ``version``; False if it is there already."""
        folder = f"{kind}-{uuid.uuid4().hex}"
        rows.select("job_id", "status", "owner", "lease_until", "at").write.parquet(f"{self.path}/{folder}")
        try:
            stream = self._fs.create(self._at(f"{self.path}/commits/{version + 1:012d}.commit"), False)
        except Exception as e:
            self._fs.delete(self._at(f"{self.path}/{folder}"), True)
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        stream.writeUTF(folder)
        stream.close()
        return True

    def apply(self, wanted: DataFrame, tries: int = 5) -> tuple[int, DataFrame]:
        """Write those transitions that are allowed: the last version then (a new one, if any is allowed) and all of them as they were judged."""
        for _ in range(tries):
            version = self.version()
            judged = self.judged(wanted, version)
            if judged.where("ok").isEmpty():
                return version, judged
            if self.commit(judged.where("ok"), version):
                return version + 1, judged
        raise Conflict(f"{self.path}: {tries} tries")

    def compact(self) -> int:
        """A version that holds the state alone, so that reading doesn't grow with the number of versions."""
        version = self.version()
        if version and not self.commit(self.state(version), version, "snapshot"):
            raise Conflict(self.path)
        return self.version()
