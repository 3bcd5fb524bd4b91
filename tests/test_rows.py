"""Token kernels, tasks, filters, repairs and sinks on small rows."""

import pytest
from pyspark.sql import functions as F

from loomfold.functions import text, tokens
from loomfold.operators import blocks, chat, measures, sampling
from loomfold.sources import sinks
from loomfold.streaming import incremental


def one(spark, column, kind, row):
    return spark.createDataFrame([row], kind).select(column.alias("x")).first()["x"]


def test_commit_or_edit(spark):
    step = tokens.commit_or_edit(F.col("p"), F.col("x"), F.col("c"), 9, 0.8, 0.9, 2)
    kind = "p array<int>, x array<int>, c array<double>"
    # two over the threshold: both, and an edit of what is placed
    assert one(spark, step, kind, ([9, 9, 9, 5, 5], [1, 2, 3, 6, 7], [0.85, 0.9, 0.1, 0.95, 0.89])) == [1, 2, 9, 6, 5]
    # fewer: the two most confident
    assert one(spark, step, kind, ([9, 9, 9], [1, 2, 3], [0.1, 0.5, 0.3])) == [9, 2, 3]


def test_tau_leap(spark):
    kind = "x array<int>, d array<double>, s array<double>, n array<double>, sx array<int>, nx array<int>"
    never, always = [0.0] * 3, [1e9] * 3
    leap = lambda **k: tokens.tau_leap(F.col("x"), F.col("d"), F.col("s"), F.col("n"), F.col("sx"), F.col("nx"), 1.0, F.lit(1), F.lit(5), **k)
    row = lambda d, s, n: ([1, 2, 3], d, s, n, [7, 8, 9], [4, 5, 6])
    assert one(spark, leap(), kind, row(never, never, never)) == [1, 2, 3]
    assert one(spark, leap(), kind, row(never, always, never)) == [1, 8, 9]
    assert one(spark, leap(), kind, row(always, never, never)) == [1]
    assert one(spark, leap(edit_prompt=True), kind, row(never, always, always)) == [7, 4, 8, 5, 9, 6]
    assert one(spark, leap(), kind, row(never, never, always)) == [1, 4, 2, 5, 3, 6]


def test_starts_cuts_and_draws(spark):
    a = F.col("a")
    got = lambda c, row: one(spark, c, "a array<int>", (row,))
    assert got(tokens.with_start(a, 9), [9, 1]) == [9, 9, 1] and got(tokens.ensure_start(a, 9), [9, 1]) == [9, 1] and got(tokens.ensure_start(a, 9), []) == [9]
    assert got(tokens.cut_suffix(a, F.lit(1), -100), [4, 5]) == [4, -100]
    assert got(tokens.random_length(a, 0.0, F.lit(1)), [1, 2, 3]) == 3 and 1 <= got(tokens.random_length(a, 1.0, F.lit(1)), [1, 2, 3]) <= 3
    assert got(tokens.random_length(a, 1.0, F.lit(1)), []) == 0
    assert got(tokens.start_state(a, None, 9, tokens.mask_fill(7, 2)), [1, 2]) == [9, 7, 7]
    logits = spark.createDataFrame([([0.0, 5.0, 1.0],)], "l array<double>")
    assert logits.select(tokens.gumbel_choice(F.col("l"), 0.0, F.lit(1)).alias("x")).first()["x"] == [1]
    draws = spark.range(4000).select(tokens.gumbel_choice(F.array(F.lit(0.0), F.lit(1.0)), 1.0, F.col("id")).alias("x")).groupBy("x").count().collect()
    assert abs({r["x"][0]: r["count"] for r in draws}[1] / 4000 - 0.731) < 0.03  # the softmax of (0, 1)
    assert one(spark, tokens.top_k_keep(F.col("a"), 2), "a array<double>", ([1.0, 3.0, 2.0],)) == [False, True, True]


def test_tasks(spark):
    rows, names = chat.task("countdown")
    df = spark.createDataFrame([([1, 2, 3], 6), ([1, 2], 3)], "nums array<int>, target int")
    got = rows(df).collect()
    assert len(got) == 1 and "the numbers [1, 2, 3], create" in got[0]["prompt"][0]["content"] and len(names) == 1
    sudoku = chat.sudoku_rows(spark.createDataFrame([("0" * 16, "1" * 16)], "Puzzle string, Solution string")).first()
    assert sudoku["prompt"][0]["content"].endswith("puzzle: " + "0" * 16 + "\n")
    assert chat.gsm8k_rows(spark.createDataFrame([("q", "x #### 5")], "question string, answer string")).first()["answer"] == "5"
    assert chat.code_rows(spark.createDataFrame([("q", "s", "t")], "question string, solution string, test string")).first()["answer"]["tests"] == "t"
    with pytest.raises(ValueError, match="unknown task"):
        chat.task("none")


def test_repairs(spark):
    log = spark.createDataFrame([("a", "Wait, so", "देर हो गई, ठीक", False), ("b", "x", None, False), ("c", "y", "z", True), ("d", "k", "l", None)], "unit_id string, en string, hi string, exhausted boolean")
    new = spark.createDataFrame([("b", "B"), ("d", "D")], "unit_id string, hi string")
    got = {r["unit_id"]: (r["how"], r["hi"]) for r in chat.repair(log, new).collect()}
    assert got == {"a": ("substituted", "रुको, ठीक"), "b": ("retranslated", "B"), "c": ("retranslated", "z"), "d": (None, "l")}
    assert sorted(r["unit_id"] for r in chat.untranslated(log).collect()) == ["b", "c"]
    with pytest.raises(NotImplementedError):
        chat.in_language(log, "py", "other")


def test_meta_and_pairs(spark):
    kind = "problem string, generations array<string>, flags array<boolean>"
    rows = spark.createDataFrame([("p\n\nq", ["bad", "<think>t</think> good\n\nmore"], [False, True]), ("r", ["x"], [None]), ("s", ["x", "y"], [False])], kind)
    got = chat.example_meta(rows).collect()
    assert len(got) == 1 and got[0]["solution"] == "good\n\nmore" and got[0]["problem_chunks"] == ["p", "q"] and got[0]["solution_chunks"] == ["good", "more"]


def test_restore_in_one_pass(spark):
    source = "a ⟦1⟧ `code ⟦0⟧` 42 and $x$"
    safe, spans = blocks.protect(source)
    df = spark.createDataFrame([(safe, [tuple(s) for s in spans])], "t string, s array<struct<placeholder:string,original:string,kind:string,start:int,end:int>>")
    assert df.select(blocks.restore(F.col("t"), F.col("s")).alias("x")).first()["x"] == source


def test_fingerprint(spark):
    t = "## Head\n\n- **bold** one\n  - *it* two\n\nEnd: ⟦0⟧ here:"
    f = one(spark, text.fingerprint(F.col("t")), "t string", (t,))
    assert (f["bullets"], f["depth"], f["bold"], f["italic"], f["heading"], f["placeholders"], f["colon"]) == (2, 2, 1, 1, 2, ["⟦0⟧"], True)


def test_measures_by_group(spark):
    df = spark.createDataFrame([("a", 10, 2, 1), ("a", 5, 2, 2), ("b", 4, 3, 3)], "g string, n int, p int, k int")
    got = {r["g"]: (r["kept_len"], r["tail"]) for r in measures.group_crop(df, "g", "n", "p", "k").collect()}
    assert got["b"] == (1, 0) and got["a"][0] in (8, 3) and 1 <= got["a"][1] < 3
    assert {r["metric"] for r in measures.split_metrics(df.withColumn("s", F.when(F.col("g") == "a", "train").otherwise("eval")), "s", {"m": F.avg("n")}).collect()} == {"m", "eval_m"}


def test_splits_and_results(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert sampling.ratio_split(df, "k", 0.1, 4).where("split = 'test'").count() == 10
    assert list(sampling.rename_splits({"train_sft": df, "x": df}, {"train_sft": "train"})) == ["train", "x"]
    out = sinks.write_results(df.select("k", (F.col("k") / 10).alias("reward")), str(tmp_path / "r"), 3)
    assert out["n"] == 100 and abs(out["mean"] - 4.95) < 1e-9
    for p in ("a", "b"):
        df.limit(5).write.parquet(str(tmp_path / p))
    streams = [incremental.read(spark, p, "k long", True) for p in (str(tmp_path / "a"), str(tmp_path / "b"))]
    q = sampling.streams_together(streams).writeStream.format("memory").queryName("together").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("together").count() == 10
