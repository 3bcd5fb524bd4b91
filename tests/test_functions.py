import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfold.functions import hashing, rewards, schedules, text, tokens
from loomfold.operators import blocks, folds


def one(spark, column, **values):
    """The column's value on a row of literals."""
    kinds = {k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k, v in values.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in kinds.items()]).select(column.alias("x")).first()["x"]


def test_text(spark):
    got = lambda c, t: one(spark, c, t=t)
    t = F.col("t")
    assert got(text.strip(t), "  a b \n") == "a b"
    assert got(text.strip_tags(t), "<think>a</think> b ") == "a b"
    assert got(text.strip_blocks(t), "<think>a\nb</think> c") == "c"
    assert got(text.numbers(t), "1,234.5% or 10-20 and ४२") == ["1,234.5%", "10-20", "४२"]
    assert got(text.sentence_count(t), " ") == 0 and got(text.sentence_count(t), "a. b! c") == 2
    assert got(text.ends_with_colon(t), "so: \n") and not got(text.ends_with_colon(t), "a:b")
    assert got(text.hash_answer(t), "x #### 12 #### 13") == "12" and got(text.hash_answer(t), "x") is None
    assert got(text.has_repetition(t), "go on go on go on go on") and not got(text.has_repetition(t), "go on go on go on")
    assert got(text.starts_with_marker(t), " Hold on, x") and not got(text.starts_with_marker(t), "so wait")
    assert got(text.prior_context(t, 10), "first words and last") == "and last" and got(text.prior_context(t), "  ") is None
    assert got(text.token_list(t), "[1; 22]") == [1, 22] and got(text.token_list(t), "[]") == []
    assert got(text.line_starts(t), "ab\n\nc") == [0, 3, 4]
    masked = got(text.mask_latex(t), "a $x$ b \\(y\\)")
    assert masked["parts"] == ["$x$", "\\(y\\)"]
    assert one(spark, text.unmask_latex(F.col("m"), F.col("p")), m=masked["masked"], p=masked["parts"]) == "a $x$ b \\(y\\)"


def test_split_is_the_digest_modulo(spark):
    import hashlib

    rows = spark.range(300).select("id", hashing.md5_mod(F.concat(F.lit("split:"), F.col("id").cast("string")), 10_000).alias("m")).collect()
    assert all(r["m"] == int(hashlib.md5(f"split:{r['id']}".encode()).hexdigest(), 16) % 10_000 for r in rows)
    assert hashing.shards_needed(10, 1000, 100, 8) == 2 and hashing.shards_needed(5000, 9000, 100, 8) == 8


def test_tokens(spark):
    a = F.col("a")
    got = lambda c, **v: one(spark, c, **v)
    assert got(tokens.clip(a, 2), a=[1, 2, 3]) == [1, 2] and got(tokens.clip(a, 2, "left"), a=[1, 2, 3]) == [2, 3] and got(tokens.clip(a, 9, "left"), a=[1]) == [1]
    assert got(tokens.clip_response(a, F.lit(2), 3), a=[1, 2, 3, 4]) == [1, 2, 3]
    assert got(tokens.clip_response(a, F.lit(2), 2, "left"), a=[1, 2, 3, 4]) == [1, 2, 3, 4]
    assert got(tokens.with_end(a, 9), a=[1, 9]) == [1, 9] and got(tokens.with_end(a, 9), a=[1]) == [1, 9]
    assert got(tokens.pad_to_multiple(a, 4, 0), a=[1, 2, 3, 4, 5]) == [1, 2, 3, 4, 5, 0, 0, 0] and got(tokens.pad_mask(a, 3), a=[7]) == [1, 0, 0]
    assert got(tokens.masked_labels(a, F.lit(2)), a=[5, 6, 7]) == [-100, -100, 7]
    assert got(tokens.trim_generation(a, F.lit(2), 0, [9]), a=[0, 0, 1, 2, 3, 9, 4]) == [3]
    assert got(tokens.infill(a, F.col("b"), 7, [9]), a=[1, 7, 7, 7], b=[1, 5, 9, 6]) == [5]
    assert got(tokens.positions(a), a=[0, 1, 1, 0, 1]) == [0, 0, 1, 0, 2]
    assert got(tokens.commit_over(a, 0.9), a=[0.5, 0.95, 0.2]) == [1] and got(tokens.commit_over(a, 0.9), a=[0.5, 0.6]) == [1]
    edits = got(tokens.edit_script(a, F.col("b")), a=[5, 6, -1, 8], b=[5, 7, 9, -1])
    assert [(e["kind"], e["pos"], e["token"]) for e in edits] == [("SUB", 1, 7), ("INS", 1, 9), ("DEL", 2, None)]
    assert tokens.align([1, 2, 3], [1, 3]) == ([1, 2, 3], [1, -1, 3])


def test_rewards(spark):
    got = lambda c, t: one(spark, c, t=t)
    t = F.col("t")
    assert got(rewards.repetition_penalty(t), "a b a b a b a b") == 1.0 and got(rewards.repetition_penalty(t), "short text") == 0.0
    assert got(rewards.script_penalty(t), "नमस्ते दुनिया") == 0.0 and got(rewards.script_penalty(t), "12, 3.5%") == 0.0
    assert 0 < got(rewards.script_penalty(t), "नमस्ते hello दुनिया") < 1 and got(rewards.script_penalty(t), "all latin") == 1.0
    assert got(rewards.xml_answer(t), "<answer>1</answer><answer> 2 </answer>") == "2"
    assert got(rewards.sudoku(t, F.lit("0200" + "1" * 12), F.lit("1234" + "1" * 12)), "<answer>1299</answer>") == pytest.approx(1 / 3)
    assert not got(rewards.safe_code(t), "import os") and got(rewards.safe_code(t), "x = 1")
    assert got(rewards.fenced_code(t), "a ```python\nx = 1\n``` b ```python\ny```") == "x = 1\n" and got(rewards.fenced_code(t), "a") == ""
    assert got(rewards.code_in_answer(t), "<answer>```python\nx```</answer>") == 0.5 and got(rewards.code_in_answer(t), "```python\nx```<answer></answer>") == 0.0
    assert got(rewards.tested_name(t), "from solution import go\nassert f(1)") == "go" and got(rewards.tested_name(t), "assert f (1)") == "f" and got(rewards.tested_name(t), "x") is None
    assert got(rewards.renamed_code(t, F.lit("go")), "x\ndef a(b):\n  pass\ndef ab():\n  a(1)\ndef a():\n") == "x\ndef go(b):\n  pass\ndef ab():\n  a(1)\ndef go():\n"
    assert got(rewards.split_tests(t), "assert a\nx\nassert b")[1] == "def test_case_2():\n    assert b"
    assert [got(rewards.boxed_format(t), x) for x in ("", "\\boxed{1}", "<answer>1</answer>", "<answer>\\boxed{1}", "\\boxed <answer> x")] == [0.25, 0.5, 0.75, 1.0, 0.75]
    assert rewards.boxed(r"so \boxed{\frac{1}{2}}") == r"\frac{1}{2}" and rewards.boxed(r"\boxed{1") is None and rewards.boxed("7") == "7"
    assert rewards.same_answer("1/2", r"\frac12") and rewards.same_answer("x = 5", "5") and not rewards.same_answer("4", None)
    assert rewards.countdown_score("<answer>(1+2)*3</answer>", 9, [1, 2, 3]) == 1.0 and rewards.countdown_score("<answer>9</answer>", 9, [1, 2]) == 0.1 and rewards.countdown_score("9", 9, [9]) == 0.0
    assert rewards.arithmetic("2**3//3") == 2 and rewards.arithmetic("9**9**9") is None and rewards.arithmetic("__import__('os')") is None and rewards.arithmetic("1/0") is None


def test_schedules(spark):
    t = F.col("t")
    assert one(spark, schedules.alpha("Linear", t), t=0.25) == 0.75 and one(spark, schedules.kappa("cosine", t), t=1.0) == pytest.approx(1.0)
    assert one(spark, schedules.even_steps(F.col("n"), 4), n=10) == [3, 3, 2, 2]
    assert sum(one(spark, schedules.transfer_steps(F.col("n"), 5), n=13)) == 13
    with pytest.raises(ValueError):
        schedules.alpha("none", t)
    with pytest.raises(Exception, match="t must lie"):
        one(spark, schedules.alpha("linear", t), t=1.5)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.integers(1, 90), max_size=30), min_size=10, max_size=20))
def test_budget_groups_follow_the_rule(spark, lists):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, n array<int>").select("n", folds.budget_groups(F.col("n"), 100).alias("g")).collect()
    for r in rows:
        want, group, run = [], -1, 0
        for n in r["n"]:
            if group < 0 or run > 0 and run + n > 100:
                group, run = group + 1, 0
            run += n
            want.append(group)
        assert r["g"] == want


def test_step_reasons(spark):
    units = [(50, False, False, None), (60, False, False, 0.1), (30, True, False, 0.9), (10, False, True, 0.9), (200, False, False, 0.9), (5, False, False, 0.9)]
    kind = "u array<struct<tokens:int,heading:boolean,marker:boolean,similarity:double>>"
    got = spark.createDataFrame([(units,)], kind).select(folds.step_breaks(F.col("u"), 150, 40, F.lit(0.2)).alias("w")).first()["w"]
    assert got == ["start", "semantic_break", "heading", "discourse_marker", None, "token_cap"]


TEXTS = ["# Title\n\nA paragraph with `code` and $x^2$, 42.\nMore.\n\n- a\n- b\n  - c\n\n```py\nx = $1\n\ny\n```\n\n> quote\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n\n$$\na+b\n$$\nend", "lone ` tick and $5 and $6.50", "", "   \n\n", "text:\n* one\n\n  two\n* three\n\nnext [l](http://a.b/c(d) x)"]


def test_blocks_and_spans():
    kinds = [k for k, _, _ in blocks.scan_blocks(TEXTS[0])]
    assert kinds == ["heading", "paragraph", "list", "code", "quote", "table", "rule", "math", "paragraph"]
    rng = random.Random(1)
    for t in TEXTS + ["".join(rng.choice("ab \n`$#-*|>1.[]()") for _ in range(80)) for _ in range(300)]:
        found = blocks.scan_blocks(t)
        assert not found if not t.strip() else found[0][1] == 0 and found[-1][2] == len(t)
        assert all(a < b for _, a, b in found) and all(x[2] <= y[1] for x, y in zip(found, found[1:], strict=False))
        safe, spans = blocks.protect(t)
        for place, original, *_ in spans:
            safe = safe.replace(place, original, 1)
        assert safe == t
    # any two dollars that no backslash escapes make mathematics
    assert [s[2] for s in blocks.protect("costs \\$5 and $x$")[1]] == ["number", "math_inline"]
    assert [s[1] for s in blocks.protect("costs $5 and $x$")[1]] == ["$5 and $"]


def test_unit_checks(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert all(r["ordered"] and r["whole"] for r in blocks.check_units(blocks.block_units(docs), docs).collect())
