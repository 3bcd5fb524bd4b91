import json

import pytest
from pyspark.sql import functions as F

from loomfold.operators import chat, joins, sampling
from loomfold.sources import readers, sinks
from loomfold.streaming import incremental


def test_tolerant_and_strict(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"id": "1", "v": 2}\nbroken\n\n{"v": 3}\n')
    assert [r["id"] for r in readers.read_tolerant(spark, str(f), "id string, v int").collect()] == ["1"]
    assert readers.read_tolerant(spark, str(tmp_path / "none"), "id string").count() == 0
    with pytest.raises(Exception):
        readers.read_strict(spark, str(f), "id string, v int").collect()


def test_csv_keeps_zeros(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Puzzle,Solution\n0012,0312\n")
    assert readers.read_strings_csv(spark, str(tmp_path / "a.csv"), ["Puzzle", "Solution"]).first()["Puzzle"] == "0012"


def test_batch_results(spark, tmp_path):
    ok = {"custom_id": "1", "response": {"body": {"choices": [{"message": {"content": " x "}}]}}}
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, [ok, {"custom_id": "2", "error": "bad"}, {"custom_id": "3", "response": {"body": {"choices": []}}}])))
    assert {r["custom_id"]: r["content"] for r in readers.read_batch_results(spark, str(tmp_path / "r.jsonl")).collect()} == {"1": "x", "3": ""}


def test_specs():
    assert readers.parse_spec("a/b[train:5_000, test:2]") == ("a/b", {"train": 5000, "test": 2})
    assert readers.parse_spec("x [ a : b ]") == ("x", {"a": "b"}) and readers.parse_spec("a=1,b=c") == (None, {"a": 1, "b": "c"})
    assert readers.split_specs("a + b[c:1] | d") == ["a", "b[c:1]", "d"] and readers.name_fits("org/alpaca-x", ["alpaca"])
    with pytest.raises(ValueError):
        readers.parse_spec("a[b]")
    assert readers.merge_settings({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(FileNotFoundError):
        readers.resolve_path("no/such", "NO_SUCH_VARIABLE")


def test_limits_and_unions(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    out = sampling.limit_splits({"train": df}, {"train": 3, "test": 2}, "k")
    assert [r["k"] for r in out["test"].collect()] == [0, 1] and [r["k"] for r in out["train"].collect()] == [2, 3, 4]
    both = sampling.limit_splits({"train": df}, {"train": 3, "test": 2}, "k", overlap=True)
    assert [r["k"] for r in both["test"].collect()] == [0, 1] and both["train"].count() == 3
    assert sampling.merge_splits([{"train": df}, {"train": df, "test": df}])["train"].count() == 20


def test_sinks(spark, tmp_path):
    steps = [{"en": "a", "hi": "b", "token_count": 9, "has_missing_translation": False}, {"en": "a", "hi": "", "token_count": 9, "has_missing_translation": None}]
    kind = "doc_id string, steps array<struct<en:string,hi:string,token_count:int,has_missing_translation:boolean>>"
    docs = spark.createDataFrame([("1", steps), ("2", steps[1:])], kind)
    assert sinks.write_kept(docs, str(tmp_path / "k"), 5) == (1, 1)
    assert "| Total | 1,000 | 2,000 |" in sinks.dataset_card("t", [("a", 1000, 2000), (None, 1000, 2000)])
    assert json.loads(sinks.flagged_report(spark.createDataFrame([(1, None)], "a int, b string"), ["a"], 5)) == [{"a": 1, "b": None}]


def test_chat_and_joins(spark):
    turn = "array<struct<from:string,value:string>>"
    rows = spark.createDataFrame([([("gpt", "A"), ("human", "Q"), ("gpt", "B")],), ([("human", "Q")],)], f"conversations {turn}")
    got = chat.qa_document(rows, "s").collect()
    assert len(got) == 1 and got[0]["question"] == "Q" and got[0]["cot_answer"] == "A"
    with pytest.raises(Exception, match="unknown"):
        chat.remap(spark.createDataFrame([("z",)], "c string"), "c", {"a": "b"}).collect()
    a, done = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "id string"), spark.createDataFrame([("1",), (None,)], "id string")
    assert [x.count() for x in joins.chained_sampling([a, a], done)] == [3, 1]
    log = spark.createDataFrame([("u", 1, "x"), ("u", 2, "y")], "unit_id string, n int, hi string")
    assert [r["hi"] for r in incremental.last_versions(log, "unit_id", "n").collect()] == ["y"]


def test_stream_appends_once(spark, tmp_path):
    src, out, kind = str(tmp_path / "in"), str(tmp_path / "out"), "id long, v string"
    run = lambda checkpoint: incremental.append_new(incremental.read(spark, src, kind, True, files_per_batch=1), out, str(tmp_path / checkpoint), "id").awaitTermination(120)
    for part in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, kind).write.mode("append").parquet(src)
    for more in ([], [(3, "c"), (4, "d"), (4, "d")]):
        if more:
            spark.createDataFrame(more, kind).coalesce(1).write.mode("append").parquet(src)
        for _ in (1, 2):  # a run that is begun again adds nothing
            run("c1")
            assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, *([4] if more else [])]
    with pytest.raises(ValueError, match="another checkpoint"):
        run("c2")


def test_appends_do_not_read_the_target(spark, tmp_path):
    src, out, kind = str(tmp_path / "in"), str(tmp_path / "out"), "id long, v string"
    for n in range(3):
        spark.createDataFrame([(n, "x"), (n + 1, "y")], kind).coalesce(1).write.mode("append").parquet(src)
    q = incremental.append_new(incremental.read(spark, src, kind, True, files_per_batch=1), out, str(tmp_path / "c"), "id")
    q.awaitTermination(120)
    for p in q.recentProgress:
        assert [s["description"] for s in p["sources"]] == [f"FileStreamSource[file:{src}]"]
    assert spark.read.parquet(out).count() == 4


def test_take_and_skip_are_the_same_in_a_stream(spark, tmp_path):
    src, kind = str(tmp_path / "in"), "g string, n long"
    rows = [("ab"[n % 2] if n % 7 else "c", n) for n in range(60)]
    for at in range(0, 60, 20):  # three triggers
        spark.createDataFrame(rows[at : at + 20], kind).coalesce(1).write.mode("append").parquet(src)
    for skip, take in ((0, 3), (12, 9), (22, 100), (5, 0)):
        batch = incremental.take_after(spark.read.parquet(src), "g", "n", skip, take)
        stream = incremental.take_after(incremental.read(spark, src, kind, True, files_per_batch=1), "g", "n", skip, take)
        out = str(tmp_path / f"out-{skip}-{take}")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
        got = sorted(tuple(r) for r in spark.read.schema(kind).parquet(out).collect())
        assert got == sorted(tuple(r) for r in batch.collect()) and all(sum(1 for g, _ in got if g == x) <= take for x in "abc")


def test_quarantine_and_retries(spark):
    work = incremental.guarded(lambda v: str(10 // int(v)))
    good, bad = incremental.quarantine(spark.createDataFrame([("5",), ("0",)], "v string"), work(F.col("v")), "r")
    assert [r["r"] for r in good.collect()] == ["2"] and "ZeroDivisionError" in bad.first()["error"]
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return [1.0] * len(texts)

    assert incremental.call_with_retries(flaky, ["a"], wait=0) == [1.0] and len(calls) == 3
    out = incremental.attempts(spark.createDataFrame([("u", "t")], "unit_id string, text string"), lambda t, heat: t + ("!" if heat else ""), lambda t, got: None if got.endswith("!") else "flat").first()
    assert (out["hi"], out["retries"], out["had_defect"], out["exhausted"]) == ("t!", 1, True, False)
