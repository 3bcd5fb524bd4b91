"""Importance resampling to a target distribution over hashed n-grams.

One scan of a document keeps a ring of running CRC states, one for each of the last n word starts. A word extends each by a
space and itself and starts one more; each state then is the CRC of one n-gram that ends at the word, and its bucket is emitted.
Bucket counts of the corpus and of the target give each bucket's gain; a document's weight is the mean gain of its n-grams, and
the rows with the highest weights plus Gumbel noise are drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import ranked
from .shared import Scratch, bounded_batches

COUNTED = "key long, n_words long, n_features long, buckets array<int>, counts array<long>"
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20


def word_table() -> bytes:
    """Each byte as it counts: A-Z lower-cased, digits, a-z and bytes of other characters as they are, the rest a space."""
    kept = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    lower = [b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)]
    return bytes(b if b in kept else 0x20 for b in lower)


def blocks_of_words(data: bytes, table: bytes, block: int = BLOCK):
    """Lists of the words of a UTF-8 text, about a block of bytes at a time; no word is cut."""
    import re

    between, at = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 0
    while at < len(data):
        end = between.search(data, at + block)
        stop = end.end() if end else len(data)
        yield data[at:stop].translate(table).split()
        at = stop


def ring_buckets(words: list[bytes], ring: list[int], longest: int, buckets: int) -> tuple[list[int], list[int]]:
    """The buckets of all runs of 1 to ``longest`` words that end in these words, and the ring for the words that follow."""
    from zlib import crc32

    out: list[int] = []
    for w in words:
        if longest > 1:
            spaced = b" " + w
            ring = [crc32(spaced, state) for state in ring[1 - longest :]] if ring else []
        else:
            ring = []
        ring.append(crc32(w))
        out += ring
    return [c % buckets for c in out], ring


def _count(longest: int, buckets: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = word_table()
        for b in batches:
            keys, words, features, sizes, found, times = b.column(0), [], [], [], [], []
            for text in b.column(1):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                ring, n_words, held, parts = [], 0, None, []
                for block in blocks_of_words(data, table):
                    n_words += len(block)
                    got, ring = ring_buckets(block, ring, longest, buckets)
                    parts.append(np.array(got, dtype=np.int64))
                    if len(data) > BLOCK:  # long texts: a dense row of counts in place of their buckets
                        held = np.bincount(parts.pop(), minlength=buckets) + (0 if held is None else held)
                if held is None:
                    own, count = np.unique(parts[0], return_counts=True) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
                else:
                    own = np.flatnonzero(held)
                    count = held[own]
                words.append(n_words)
                features.append(int(count.sum()))
                sizes.append(len(own))
                found.append(own)
                times.append(count)
            starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            joined = lambda rows, kind: pa.array(np.concatenate(rows).astype(kind) if rows else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.ListArray.from_arrays(starts, joined(found, np.int32)), pa.ListArray.from_arrays(starts, joined(times, np.int64))],
                names=["key", "n_words", "n_features", "buckets", "counts"],
            )

    return run


def counted(docs: DataFrame, doc_id: str, text: str, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """``key, n_words, n_features`` and the document's distinct buckets with their counts, in one scan of each whole text."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("key"), F.col(text).cast("string").alias("body")).mapInArrow(_count(longest, buckets), COUNTED)


def bucket_totals(rows: DataFrame) -> DataFrame:
    """``bucket, n`` over all rows of :func:`counted`, combined before they are exchanged."""
    pairs = rows.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def bucket_gains(corpus, target):
    """1000 times the log of the target's smoothed share of each bucket over the corpus's, floored, from arrays of counts."""
    import numpy as np

    s, t, buckets = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(held):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            features = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = b.column(3).offsets.to_numpy().astype(np.int64)
            found, times = b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy()
            sums = np.concatenate([[0], np.cumsum(held.value[found] * times)])[offsets - offsets[0]]
            weight = np.where(features > 0, np.diff(sums) // np.maximum(features, 1), 0)  # rounds down
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(weight, pa.int64())], names=["key", "n_words", "n_features", "weight"])

    return run


def gumbel(key: Column, seed: int) -> Column:
    """Noise of a row from its key, floored thousandths: the same in every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` is null where it isn't drawn.

    Of the rows with at least ``least_words`` words, ``percent`` of a hundred with the highest scores are drawn, ties to the
    smaller id. Null and empty texts have no features and weight 0. Rows that repeat count each; the same id gives them the
    same noise. A null id has the noise of the empty string and comes before the others among equal scores. Further columns
    are not read. An empty target gives each bucket the gain of its absence; an empty table gives no rows.

    Features are counted in one scan of the texts; what is exchanged and ranked afterwards has no text. Driver and broadcast hold a
    number for each bucket. The counts stay in the shared folder until the result's tables are written, the ranked rows until
    the application ends.
    """
    import numpy as np

    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.table(counted(docs, doc_id, text, longest, buckets), "features")
        wanted = counted(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_text, longest, buckets)
        of_corpus, of_target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for side, found in ((of_corpus, bucket_totals(rows)), (of_target, bucket_totals(wanted))):
            for r in found.collect():  # a row for each bucket at most
                side[r["bucket"]] = r["n"]
        held = spark.sparkContext.broadcast(bucket_gains(of_corpus, of_target))
        weighed = rows.mapInArrow(_weigh(held), "key long, n_words long, n_features long, weight long")
        scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)).withColumn("able", F.col("n_words") >= least_words).drop("n_words")
        scored = scratch.table(scored, "scores", keep=True)
    able, n = ranked(scored.where("able").withColumn("down", -F.col("score")), "down", "place", tie="key")
    drawn = able.select("key", "n_features", "weight", "score", F.when(F.col("place") <= percent * n // 100, F.col("place")).cast("long").alias("rank"))
    rest = scored.where("not able").select("key", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest).withColumnRenamed("key", "doc_id")


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    """A tenth of ``documents`` drawn towards the words of ``benchmark``."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


OP13_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM documents
  UNION ALL
  SELECT 't', 0, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) FROM benchmark),
vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM words),
bucketed AS (
  SELECT w, xor(list_reduce(
      list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
      lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, b)),
      4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM vocabulary),
features AS (SELECT side, id, bucket FROM words JOIN bucketed USING (w)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM features GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM counts, sums),
weighed AS (SELECT id AS doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM features JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM (SELECT doc_id FROM documents) LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
