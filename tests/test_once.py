from pyspark.sql import functions as F

from loomfold.functions import scans
from loomfold.plans import catalogue


def test_units_are_made_once(spark):
    """A filter on the last units was moved down to the scan, and all steps before it were worked out twice."""
    plan = catalogue.QUERIES["unit_invariants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_scan_gives_states_before_and_after(spark):
    arrays = [list(range(n)) for n in (0, 1, 2, 3, 10, 101)] + [None]
    df = spark.createDataFrame([(x,) for x in arrays], "a array<int>")
    pair = scans.scan(F.col("a"), F.struct(F.lit(5).alias("n")), lambda s, x: F.struct((s["n"] + x).alias("n")), lambda before, x, after: F.struct(before["n"].alias("b"), x.alias("x"), after["n"].alias("e")), "struct<b:int,x:int,e:int>")
    got = [r["p"] and [tuple(z) for z in r["p"]] for r in df.select(pair.alias("p")).collect()]
    sums = lambda n: 5 + n * (n - 1) // 2
    assert got == [x and [(sums(i), i, sums(i + 1)) for i in x] if x is not None else None for x in arrays]
