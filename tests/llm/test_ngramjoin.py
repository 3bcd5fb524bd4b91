import random

import numpy as np
import pytest

from loomfold.llm import ngramjoin as m
from loomfold.llm.components import connected_components
from loomfold.llm.shared import Scratch

from .conftest import near_copies


def brute(rows, words, percent):
    """Components by comparing all pairs."""
    shingler = m.Shingler(words)
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(set(shingler.of((t or "").encode()).tolist()))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("words", "percent", "hot", "block"), [(3, 90, 16, 2_000_000), (3, 80, 2, 200), (5, 80, 3, 400)])
def test_components_match_all_pairs(spark, words, percent, hot, block):
    rows = list(enumerate(near_copies(1) + near_copies(2, 3, 14)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, ""), (1004, "one"), (1005, "one")]
    got = m.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words, percent, hot, block).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, words, percent)
    assert len(got) == len(rows)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = m.jaccard_components(odd_docs, 3, 90).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0
    assert by[0]["component_id"] == 0 and by[1]["component_id"] == 1
    assert by[4]["n_shingles"] == 1 and by[90]["component_id"] == 5
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert m.jaccard_components(no_docs).count() == 0


def test_group_is_resolved_as_by_all_pairs():
    rng = random.Random(5)
    for trial in range(30):
        base = [rng.sample(range(10_000), 60) for _ in range(3)]
        sets = []
        for _ in range(40):
            own = set(rng.choice(base))
            for _ in range(rng.randint(0, 9)):
                own.discard(rng.choice(sorted(own)))
                own.add(rng.randrange(10_000) if rng.random() < 0.5 else rng.choice(base[0]))
            sets.append(np.array(sorted(own), dtype=np.uint64))
        percent = (80, 90)[trial % 2]
        links = m.resolve_group(list(range(40)), sets, percent)
        want = [(a, b) for b in range(40) for a in range(b) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        assert set(tuple(sorted(x)) for x in links) <= set(want)

        def labels(pairs):
            parent = list(range(40))

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in pairs:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
            return [root(i) for i in range(40)]

        assert labels(links) == labels(want)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(Scratch(spark), edges).collect()}
    assert set(got.values()) == {1, 100} and got[40] == 1 and got[101] == 100
    assert connected_components(Scratch(spark), edges.limit(0)).count() == 0


def test_more_matches_where_postings_are_long():
    assert m.choose_matches(100, 3, [1, 1, 1]) == 1
    assert m.choose_matches(5000, 3, [2, 2, 2, 3, 3, 3]) > 1


@pytest.mark.parametrize(("words", "percent", "hot", "block"), [(3, 90, 16, 2_000_000), (3, 80, 2, 200), (5, 80, 3, 400)])
def test_links_are_counted_as_by_all_pairs(spark, words, percent, hot, block):
    rows = list(enumerate(near_copies(1) + near_copies(2, 3, 14)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, ""), (1004, "one"), (1005, "one"), (None, "one"), (7, rows[40][1])]
    got = m.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words, percent, hot, block, links=True).collect()
    shingler = m.Shingler(words)
    sets = [(i, set(shingler.of((t or "").encode()).tolist())) for i, t in rows if i is not None]
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= percent * len(x | y)
    want = sorted((i, sum(linked(x, y) for k, (_, y) in enumerate(sets) if k != own)) for own, (i, x) in enumerate(sets))
    assert sorted((r["doc_id"], r["n_links"]) for r in got if r["doc_id"] is not None) == want
    assert [r["n_links"] for r in got if r["doc_id"] is None] == [None]


def test_counts_within_a_group_match_all_pairs():
    rng = random.Random(8)
    for trial in range(30):
        base = [rng.sample(range(10_000), 60) for _ in range(3)]
        sets = []
        for _ in range(40):
            own = set(rng.choice(base))
            for _ in range(rng.randint(0, 9)):
                own.discard(rng.choice(sorted(own)))
                own.add(rng.randrange(10_000) if rng.random() < 0.5 else rng.choice(base[0]))
            sets.append(np.array(sorted(own), dtype=np.uint64))
        percent, weights = (80, 90)[trial % 2], [rng.randint(1, 3) for _ in sets]
        linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))
        for blocks in ([4] * 40, [rng.randrange(2) for _ in sets]):
            apart = len(set(blocks)) > 1
            want = [sum(weights[b] for b in range(40) if b != a and linked(a, b) and (not apart or blocks[a] != blocks[b])) for a in range(40)]
            assert m.count_links(sets, weights, blocks, percent).tolist() == want and max(want) > 5
