import random

import numpy as np
import pyarrow as pa
import pytest

from loomfold.llm.bitslice import Block, _build, added, build_index, highest, op11_bit_sliced, quantised, reaching, search_index

KIND = "vec_id long, embedding array<float>, block string, score double"


def by_hand(rows, every=5, k=10):
    """(query_id, rank, vec_id, score) with Python's own integers."""
    import math

    own = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {(i, tuple(q)) for i, q in own if i % every == 0}
    found = {}
    for i, q in asked:
        for j, v in own:
            if j != i and len(v) == len(q):
                found.setdefault(i, []).append((-sum(a * b for a, b in zip(q, v, strict=True)), j))
    return sorted((i, n + 1, j, -s) for i, f in found.items() for n, (s, j) in enumerate(sorted(f)[:k]))


def search(spark, rows, every=5, k=10, broadcast_bytes=64 << 20, **kw):
    table = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "b", 0.0) for i, v in rows], KIND).repartition(3)
    index, blocks = build_index(table, **kw)
    queries = table.where(f"vec_id % {every} = 0").select(table["vec_id"].alias("query_id"), quantised(table["embedding"]).alias("vector")).dropDuplicates()
    return sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in search_index(index, blocks, queries, k, broadcast_bytes=broadcast_bytes).collect())


@pytest.mark.parametrize("seed", range(5))
def test_bitmaps_add_and_select_as_numbers_do(seed):
    rng = np.random.default_rng(seed)
    rows, words = 150, 3
    bitmap = lambda bits: np.packbits(np.concatenate([bits, np.zeros(words * 64 - rows, bool)]), bitorder="little").view("<u8")
    stacks, sums = [], np.zeros(rows, dtype=object)
    for w in range(6):
        own = rng.random((rng.integers(0, 9), rows)) < 0.5
        stacks.append(np.array([bitmap(x) for x in own], "<u8").reshape(-1, words))
        sums = sums + own.sum(0).astype(object) * (1 << w)
    slices = added(stacks)
    bits = lambda s: np.zeros(rows, int) if s is None else np.unpackbits(s.view(np.uint8), bitorder="little")[:rows].astype(int)
    assert (sum(bits(s).astype(object) << i for i, s in enumerate(slices)) == sums).all()
    counts = rng.random(rows) < 0.7
    for k in (1, 2, 10, 100, 149):
        want = sorted((int(x) for x in sums[counts]), reverse=True)
        assert highest(slices, bitmap(counts), k) == (want[k - 1] if k <= len(want) else 0)
    for least in (-3, 0, 1, 17, int(max(sums)), int(max(sums)) + 1, 1 << 40):
        assert (bits(reaching(slices, bitmap(counts), least)) == (counts & (sums >= least))).all()


@pytest.mark.parametrize(("dims", "spread"), [(1, 3), (7, 900), (33, 20), (4, 0)])
def test_a_block_finds_what_a_sort_finds(dims, spread):
    rng = np.random.default_rng(dims)
    x = rng.integers(-spread, spread + 1, (1000, dims))
    x[200:500] = x[3]
    ids = rng.permutation(5000)[:1000]
    block = Block(_build(pa.table({"block": ["b"] * 1000, "vec_id": pa.array(ids, pa.int64()), "vector": pa.array(list(x), pa.list_(pa.int64()))})).to_pylist()[0])
    order = np.argsort(ids)
    assert (block.values(np.arange(1000)) == x[order]).all()
    for n in range(0, 1000, 37):
        scores, found = block.search(x[n], int(ids[n]), 10)
        all_scores, other = x @ x[n], np.flatnonzero(ids != ids[n])
        best = other[np.lexsort((ids[other], -all_scores[other]))[:10]]
        assert list(found) == list(ids[best]) and list(scores) == list(all_scores[best])


def test_blocks_and_parts_give_what_a_full_search_gives(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(260)] + [(1000 + i, [0.5] * 6) for i in range(120)] + [(7, [0.25] * 3), (10, [1.0, -2.0, 0.0]), (12, [3.0, 1.0, 9.0])]
    want = by_hand(rows, 10)
    assert search(spark, rows, 10, block_rows=64) == want
    assert search(spark, rows, 10, block_rows=64, broadcast_bytes=0) == want


def test_unusable_vectors_ties_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, None), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, []), (15, []), (None, [1.0, 1.0]), (16, [-1.0, -1e-9]), (20, [0.0, 0.0]), (-5, [-0.5, 2.0])]
    assert search(spark, rows, k=3) == by_hand(rows, k=3)
    assert search(spark, []) == [] and search(spark, [(0, [1.0])]) == []


def test_large_components_are_exact(spark):
    rows = [(i, [3e5 * (-1) ** i, 1e-3 * i, 1.0]) for i in range(40)] + [(i, [3e4, float(i), -1e6]) for i in range(40, 60)]
    assert search(spark, rows) == by_hand(rows)
    most = (1 << 63) - 1
    assert {abs(s) for *_, s in search(spark, [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e38, 0.0])])} == {most}


def test_the_query_is_exact_on_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in op11_bit_sliced(spark, "/root/testdata/sf0.1").collect())
    assert got == by_hand(rows, 100)
