"""Line dedup over levelled, sorted runs of line hashes.

A *run* is a table of line keys (128-bit hash) with the smallest document that holds each, bucketed and sorted by hash, in
the folder that all machines share. Batches arrive in ascending order of document id. The distinct keys of a batch are
looked up in all runs by merge joins that need no exchange on the runs' side; keys that no run has (the merge anti-join)
become the batch's own run. When a level has ``fanout`` runs they are compacted into one run of the next level, and the
old ones are deleted. As every key enters once, with the first document that holds it, a line goes exactly when the
recorded document is smaller than its own.

Runs that are given a ``home`` outlast the call and the session, so a later call adds the next batch to them.

Hash collisions are the only source of error: 128 bits over n lines, n * n / 2 ** 129.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, bounded_batches, delete_path, partitions, scratch_path

BLANK = b" \t\n\x0b\x0c\r"
LAST = (1 << 63) - 1  # stands for a null id: after all others
KEY = ["h1", "h2"]


def _keys_of(text: bytes | None, min_chars: int):
    """The 16-byte key of each line, None for a line too short to be compared."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    for line in (text or b"").lower().split(b"\n"):
        key = line.strip(BLANK)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            yield digest(key)
        else:
            yield None


def _line_keys(min_chars: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                counts, found = [], []
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    own = {k for k in _keys_of(text, min_chars) if k is not None}
                    counts.append(len(own))
                    found += own
                halves = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                ids, rows = (np.repeat(part.column(i).to_numpy(zero_copy_only=False), counts).astype("int64") for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids), pa.array(rows)], names=["h1", "h2", "holder", "body_hash"])

    return run


def _keep_lines(min_chars: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                gone = part.column(2)
                kept, lines, dropped = [], [], []
                for i, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    n = (text or b"").count(b"\n") + 1
                    lines.append(n)
                    if not gone[i].is_valid:
                        kept.append(text)
                        dropped.append(0)
                        continue
                    pairs = gone[i].values
                    halves = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], 1).astype("<i8")
                    bad = {x.tobytes() for x in halves}
                    stay = [line for line, k in zip((text or b"").split(b"\n"), _keys_of(text, min_chars), strict=True) if k not in bad]
                    kept.append(b"\n".join(stay))
                    dropped.append(n - len(stay))
                texts = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["rest", "kept_text", "n_lines", "n_dropped"])

    return run


class LineRuns:
    """The levelled runs. ``levels[i]`` names the tables of level i, oldest first.

    With a ``home`` the runs found there are taken up, and they stay when :meth:`close` is called. A run that was being
    written or compacted when its application died is either whole or left out, and a key in two runs does no harm.
    """

    SCHEMA = "h1 long, h2 long, holder long, fresh boolean, takes boolean, n long"

    def __init__(self, spark: SparkSession, fanout: int = 3, home: str | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.kept = home is not None
        self.home = home.rstrip("/") if home else scratch_path(spark, "line-runs")
        self.paths: dict[str, str] = {}
        self.buckets, self.number = partitions(spark), 0
        for level, number, buckets, path in sorted(self._found()) if home else []:
            self.buckets, self.number = buckets, max(self.number, number + 1)
            self.levels += [[] for _ in range(level + 1 - len(self.levels))]
            self.levels[level].append(self._register(path, buckets))

    def _found(self):
        """(level, number, buckets, path) of the whole runs in the home."""
        jvm = self.spark.sparkContext._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.home)
        fs = home.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for s in fs.listStatus(home) if fs.exists(home) else []:
            name = s.getPath().getName()
            if name.startswith("run-") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                yield *map(int, name.split("-")[1:4]), f"{self.home}/{name}"

    def _register(self, path: str, buckets: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.paths[name] = path
        return name

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, df: DataFrame, level: int) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", f"{self.home}/run-{level}-{self.number}-{self.buckets}"
        self.number += 1
        df.write.format("parquet").option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.paths[name] = path
        return name

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch (h1, h2, holder), whose holders are all at or above those before it.

        Returns the batch's keys that take lines away: h1, h2, the first holder, and n, the number of the batch's lines.
        The result is to be read before the next batch comes.
        """
        self._compact()
        keys = lines.groupBy(*KEY).agg(F.min("holder").alias("own"), (F.min("holder") < F.max("holder")).alias("shared"), F.count(F.lit(1)).alias("n"))
        known = F.lit(None).cast("long")
        for i, table in enumerate(self.tables()):
            run = self.spark.table(table).where("fresh").select(*KEY, F.col("holder").alias(f"held{i}"))
            keys = keys.join(run.hint("merge"), KEY, "left")
            known = F.coalesce(known, F.col(f"held{i}"))
        keys = keys.select(*KEY, F.coalesce(known, F.col("own")).alias("holder"), known.isNull().alias("fresh"), (F.col("shared") | (known < F.col("own"))).alias("takes"), "n")
        table = self._write(keys.where("fresh or takes"), 0)
        self.levels[0].append(table)
        return self.spark.table(table).where("takes").select(*KEY, F.col("holder").alias("first"), "n")

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                parts = [self.spark.table(t).where("fresh").select(*KEY, "holder") for t in level]
                merged = reduce(DataFrame.unionByName, parts).repartition(self.buckets, *KEY)
                merged = merged.select("*", F.lit(True).alias("fresh"), F.lit(False).alias("takes"), F.lit(1).cast("long").alias("n"))
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(merged, i + 1))
                self._drop(level)
                level.clear()

    def _drop(self, tables: list[str], files: bool = True) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            if files:
                delete_path(self.spark, self.paths.pop(t))

    def close(self) -> None:
        """Forget the tables, and delete them unless they have a home."""
        self._drop(self.tables(), files=not self.kept)
        if not self.kept:
            delete_path(self.spark, self.home)


def _lost(lines: DataFrame, taking: DataFrame, total: int) -> DataFrame:
    """The lines that go. Keys of more than a thousandth of the batch's lines - a thousand keys at most - are broadcast; so no task gets all lines of such a key."""
    bound = max(1000, total // 1000)
    hot = F.broadcast(taking.where(F.col("n") > bound).select(*KEY, "first"))
    cold = taking.where(F.col("n") <= bound).select(*KEY, "first")
    columns = ["holder", "body_hash", "h1", "h2"]
    often = lines.join(hot, KEY).where("first < holder").select(*columns)
    return often.unionByName(lines.join(hot, KEY, "left_anti").join(cold, KEY).where("first < holder").select(*columns))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3, runs: LineRuns | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``rest`` (a struct of all columns of ``docs``), ``kept_text``, ``n_lines`` and ``n_dropped``.

    Lines split at ``\\n``; a key is the line without blanks at both ends, A-Z lower-cased. Keys of at least ``min_chars``
    code points stay only in the smallest ``doc_id`` that holds them, in each of its lines. Null texts count as one empty
    line and stay null; an empty text is one empty line. Null ids are one document after all others; rows that repeat an id
    are one document; an empty table gives none. Texts and lines of any length are read whole; a text's distinct lines are
    in memory at once. Further columns, whatever their names, are carried in ``rest`` only.

    With ``runs`` the documents are the next of them: lines that an earlier call's documents hold go too. Ids are to be above
    those of earlier calls; where one isn't, what the earlier call has kept stays kept.
    """
    spark = docs.sparkSession
    bounded_batches(docs.sparkSession)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("rest"), docs[text].cast("string").alias("body"), F.coalesce(docs[doc_id].cast("long"), F.lit(LAST)).alias("holder"))
    own = own.withColumn("body_hash", F.xxhash64("body"))
    cuts = own.agg(F.percentile_approx("holder", [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"] or [] if batches > 1 else []
    cuts = sorted(set(cuts))
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("holder") > F.lit(c)).cast("int")
    held = runs or LineRuns(spark, fanout)
    with Scratch(spark) as scratch:
        lines = own.select("holder", "body_hash", "body").mapInArrow(_line_keys(min_chars), "h1 long, h2 long, holder long, body_hash long").withColumn("batch", number)
        lines = scratch.table(lines, "lines", partition_by=("batch",))
        sizes = {r["batch"]: r["n"] for r in lines.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each batch
        gone = []
        for b in range(len(cuts) + 1):
            own_lines = lines.where(F.col("batch") == b).select(*KEY, "holder", "body_hash")
            gone.append(scratch.table(_lost(own_lines, held.add(own_lines), sizes.get(b, 0)), f"lost-{b}"))
        # a row's lines are found by its id and its text, so the lists of rows without an id stay apart
        listed = reduce(DataFrame.unionByName, gone).groupBy("holder", "body_hash").agg(F.collect_set(F.struct(*KEY)).alias("gone"))
        listed = scratch.table(listed, "gone", keep=True)
    if runs is None:
        held.close()
    fields = f"rest {own.schema['rest'].dataType.simpleString()}, kept_text string, n_lines long, n_dropped long"
    return own.join(listed, ["holder", "body_hash"], "left").select("rest", "body", "gone").mapInArrow(_keep_lines(min_chars), fields)


def op9_line_runs(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` without the lines that a smaller document holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(F.col("rest.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
holders AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.doc_id, k.pos, k.line, coalesce(h.first < k.doc_id, false) AS gone FROM keyed k LEFT JOIN holders h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
