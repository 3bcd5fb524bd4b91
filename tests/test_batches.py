import random
import time

import pytest
from pyspark.sql import functions as F

from loomfold.functions import batches, scans, tokens
from loomfold.plans import catalogue


def rows(spark, arrays, kind="int"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(arrays)], f"i int, a array<{kind}>").repartition(3, "i")


def got(df, *columns):
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_totals_begin_anew_and_keep_nulls(spark):
    df = rows(spark, [[1, 2, 3], [], None, [5], [4, None, 1], [-2, 2], [2**31 - 1] * 3])
    a = F.col("a")
    for own in (True, False):
        new, old = got(df, batches.running_total(a, own)), got(df, scans.running_total(a, own))
        assert new == old
    assert got(df, batches.running_total(a))[-1] == ([2**31 - 1, 2**32 - 2, 3 * 2**31 - 3],)


def test_positions(spark):
    df = rows(spark, [[1, 0, 1, 1], None, [], [0, 0], [1]])
    assert got(df, tokens.positions(F.col("a"))) == [([0, 0, 1, 2],), (None,), ([],), ([0, 0],), ([0],)]


def test_nucleus_takes_ties_in_order_and_always_the_first(spark):
    df = rows(spark, [[0.0, 9.0, 0.0], [1.0, 1.0, 1.0, 1.0], [], None, [-500.0, 500.0], [1.0, None]], "double")
    assert got(df, tokens.top_p_keep(F.col("a"), 0.3)) == [([False, True, False],), ([True, True, False, False],), ([],), (None,), ([False, True],), ([True, False],)]


def test_edits_of_pairs_with_nulls(spark):
    df = spark.createDataFrame([(0, [5, 6, -1, 8], [5, 7, 9, -1]), (1, None, [1]), (2, [], []), (3, [-1, 4], [2, 4]), (4, [3], None), (5, [3], [3])], "i int, a array<int>, b array<int>").repartition(2, "i")
    edits = [x[0] and [tuple(e) for e in x[0]] for x in got(df, tokens.edit_script(F.col("a"), F.col("b")))]
    assert edits == [[("SUB", 1, 7), ("INS", 1, 9), ("DEL", 2, None)], None, [], [("INS", 0, 2)], None, []]


def test_alignment_in_rows_and_in_time(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [1, 3]), (1, None, [1]), (2, [], [4]), (3, [7], [])], "i int, a array<int>, b array<int>")
    out = [z[0] and (z[0]["source"], z[0]["target"]) for z in got(df, tokens.align_udf()(F.col("a"), F.col("b")))]
    assert out == [([1, 2, 3], [1, -1, 3]), None, ([-1], [4]), ([7], [-1])]
    rng = random.Random(5)
    pairs = [([rng.randrange(26) for _ in range(500)], [rng.randrange(26) for _ in range(500)]) for _ in range(40)]
    began = time.process_time()
    assert all([x for x in tokens.align(a, b)[0] if x != -1] == a for a, b in pairs)
    assert time.process_time() - began < 0.4  # about 1.1 s, row by row over numbers


@pytest.mark.parametrize("name", ["running_totals", "logical_positions", "nucleus", "edit_scripts"])
def test_queries_walk_on_batches_and_split_texts_once(spark, name):
    """A fold that appends for each element took minutes for each GB, as did a second look at the words for a filter."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "array_append" not in plan
    assert plan.count("regexp_extract_all") == 1
