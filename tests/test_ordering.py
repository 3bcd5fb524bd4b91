import random

import pytest

from loomfold.operators.ordering import cut_points, range_of, ranked, values_at


@pytest.mark.parametrize("ranges", [1, 2, 5, 16, 50])
def test_range_of_counts_the_cuts_below(spark, ranges):
    rng = random.Random(ranges)
    values = [rng.choice([None, 3, 3, rng.randrange(100)]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    cuts = cut_points(df, "v", ranges)
    for r in df.select("v", range_of(df["v"], cuts).alias("k")).collect():
        assert r["k"] == (-1 if r["v"] is None else sum(c < r["v"] for c in set(cuts)))


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_places_are_those_of_a_sort(spark, share):
    rng = random.Random(7)
    rows = [(None if rng.random() < 0.3 * share else 5 if rng.random() < share else rng.randrange(40), rng.randrange(10**6), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "v long, t long, i long").repartition(6)
    placed, n = ranked(df, "v", "at", ranges=12, tie="t")
    got = sorted(placed.collect(), key=lambda r: r["at"])
    assert n == 2000 and [r["at"] for r in got] == list(range(1, 2001))
    assert [(r["v"], r["t"]) for r in got] == sorted(((v, t) for v, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_a_constant_column_is_dealt_to_many_tasks(spark):
    df = spark.range(5000).selectExpr("id", "cast(1 AS double) AS v")
    placed, _ = ranked(df, "v", "at", ranges=8)
    assert sorted(r["at"] for r in placed.select("at").collect()) == list(range(1, 5001))
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "_sub" in plan


@pytest.mark.parametrize("n", [0, 1, 2, 999])
def test_values_at_ranks(spark, n):
    rng = random.Random(n)
    values = sorted(rng.choice([7.5, rng.random() * 20]) for _ in range(n))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = sorted({1, n // 10 + 1, n // 2 + 1, n} - {0}) if n else [1]
    assert values_at(df, "v", ranks, ranges=32) == ({r: values[r - 1] for r in ranks} if n else {})
