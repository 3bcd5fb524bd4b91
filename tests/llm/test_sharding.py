import zlib

import pytest

from loomfold.llm.sharding import histogram_shards


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_bytes_are_near_equal(spark, shards):
    rows = [(i, "the same text" if i % 3 == 0 else "x" * (i * 37 % 400)) for i in range(3000)]
    got = histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
    assert len(got) == len(rows)
    sizes, slots = dict.fromkeys(range(shards), 0), {s: [] for s in range(shards)}
    for r in got:
        t = rows[r["doc_id"]][1].encode()
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(sizes.values()) / shards
    assert max(abs(s - mean) for s in sizes.values()) <= 0.01 * mean + 2 * 416
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_small_groups_stay_whole(spark):
    rows = [(i, f"text of group {i // 4}") for i in range(4000)]
    got = histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    of = {}
    for r in got:
        of.setdefault(rows[r["doc_id"]][1], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in of.values()) <= 9


def test_slots_in_many_tasks(spark):
    from loomfold.llm import sharding

    rows = spark.range(500).selectExpr("id AS doc_id", "cast(id % 2 AS string) AS text")
    slim = rows.select("doc_id", sharding.byte_size(rows["text"]).alias("size"), *sharding.sort_keys(rows["text"], rows["doc_id"]))
    sharded = slim.withColumn("shard", sharding.shard_of(sharding.find_splitters(slim, 3)))
    slots = {}
    for r in sharding.with_slots(sharded, 500, 3, rows_per_task=20).collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(slots) == 3 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = histogram_shards(odd_docs, 4).collect()
    assert len(got) == len(odd_rows)
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 16 for _, t, *_ in odd_rows)
    assert histogram_shards(no_docs, 4).count() == 0


def test_cuts_are_those_of_a_whole_sort(spark):
    """Without tolerance the shards are those of sorting all rows and cutting the running bytes nearest to each target."""
    import random

    from pyspark.sql import functions as F

    from loomfold.llm import sharding

    rng = random.Random(5)
    same = [rng.randrange(1 << 62) for _ in range(40)]
    rows = [(rng.choice(same) if rng.random() < 0.5 else rng.randrange(1 << 62), rng.randrange(4), i, rng.choice([16, 40, 900])) for i in range(2500)]
    rows += [(same[0], 9, 10_000 + i, 30) for i in range(500)]  # a group that must be cut along the later numbers
    keyed = spark.createDataFrame(rows, "k1 long, k2 long, k3 long, size long").repartition(6)
    shards = 9
    got = keyed.withColumn("shard", sharding.shard_of(sharding.find_splitters(keyed, shards, tolerance=0.0, fanout=256))).collect()
    rows.sort()
    total, cuts, at = sum(r[3] for r in rows), [], 0
    targets = [total * j / shards for j in range(1, shards)]
    for k, r in enumerate(rows):
        while len(cuts) < len(targets) and targets[len(cuts)] <= at + r[3]:
            t = targets[len(cuts)]
            cuts.append(k if t - at <= at + r[3] - t else k + 1)
        at += r[3]
    want = {r[:3]: sum(c <= k for c in cuts) for k, r in enumerate(rows)}
    assert {(r["k1"], r["k2"], r["k3"]): r["shard"] for r in got} == want
    assert keyed.agg(F.sum("size")).first()[0] == total
