import datetime

from pyspark.sql import functions as F

from loomfold.operators import sampling
from loomfold.streaming.jobs import Ledger

KIND = "job_id string, status string, owner string, lease_until timestamp, at timestamp"
NOON = datetime.datetime(2024, 5, 1, 12)


def want(spark, *rows):
    at = lambda m: NOON + datetime.timedelta(minutes=m)
    return spark.createDataFrame([(j, s, o, at(m + 30), at(m)) for j, s, o, m in rows], KIND)


def states(ledger, version=None):
    return {r["job_id"]: (r["status"], r["owner"]) for r in ledger.state(version).collect()}


def verdicts(judged):
    return {(r["job_id"], r["status"], r["owner"]): r["ok"] for r in judged.collect()}


def test_states_follow_one_another(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "jobs"))
    assert ledger.version() == 0 and states(ledger) == {}
    n, judged = ledger.apply(want(spark, ("a", "submitted", "x", 0), ("b", "submitted", "y", 1), ("c", "completed", "x", 0), ("a", "submitted", "y", 2)))
    assert n == 1 and verdicts(judged) == {("a", "submitted", "x"): True, ("b", "submitted", "y"): True, ("c", "completed", "x"): False, ("a", "submitted", "y"): False}
    # another's job isn't ended; a lease that holds isn't taken, one that has lapsed is
    _, judged = ledger.apply(want(spark, ("a", "completed", "y", 5), ("b", "submitted", "z", 10)))
    assert not any(verdicts(judged).values())
    ledger.apply(want(spark, ("a", "failed", "x", 6), ("b", "submitted", "z", 40)))
    assert states(ledger) == {"a": ("failed", "x"), "b": ("submitted", "z")} and states(ledger, 1) == {"a": ("submitted", "x"), "b": ("submitted", "y")}
    ledger.apply(want(spark, ("a", "submitted", "y", 50), ("b", "completed", "z", 45)))
    _, judged = ledger.apply(want(spark, ("b", "submitted", "x", 600), ("a", "completed", "y", 55)))
    assert verdicts(judged) == {("b", "submitted", "x"): False, ("a", "completed", "y"): True}
    before = states(ledger)
    assert ledger.compact() == 5 and states(ledger) == before == {"a": ("completed", "y"), "b": ("completed", "z")}
    assert ledger.log().count() == 2 and ledger.log(4).count() == 7


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = Ledger(spark, str(tmp_path / "jobs")), Ledger(spark, str(tmp_path / "jobs"))
    mine, yours = want(spark, ("a", "submitted", "x", 0)), want(spark, ("a", "submitted", "y", 1), ("b", "submitted", "y", 1))
    seen = two.version()
    held = two.judged(yours, seen).where("ok")
    one.apply(mine)
    assert not two.commit(held, seen)  # judged on a version that is no longer the last
    _, judged = two.apply(yours)
    assert verdicts(judged) == {("a", "submitted", "y"): False, ("b", "submitted", "y"): True}
    assert states(one) == {"a": ("submitted", "x"), "b": ("submitted", "y")} and one.version() == 2


def test_a_two_stage_sample_reads_the_drawn_files_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).withColumn("shard", F.col("id") % 20).repartition("shard").sortWithinPartitions("id").write.partitionBy("shard").parquet(path)
    got = sampling.sample_shards(spark, path, 150, 100, seed=3, name=r"shard=\d+")
    assert len(got.inputFiles()) == 3  # 150 // 100 + 2
    rows = got.collect()
    assert len(rows) == len({r["id"] for r in rows}) == 150 and len({r["shard"] for r in rows}) == 3
    assert all(r["id"] == 20 * r["row_index"] + int(r["shard"].split("=")[1]) for r in rows)
    again = sampling.sample_shards(spark, path, 150, 100, seed=3, name=r"shard=\d+").collect()
    assert [r["id"] for r in again] == [r["id"] for r in rows]
    assert sampling.sample_shards(spark, path, 5000, 100, name=r"shard=\d+").count() == 2000
    assert sampling.sample_shards(spark, path, 500, 1000, name=r"shard=\d+").count() == 200
