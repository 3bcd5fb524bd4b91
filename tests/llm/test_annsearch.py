import numpy as np
import pyarrow as pa

from loomfold.llm.annsearch import INDEX, _build, build_graph, build_index, load_graph, op2_hnsw, search_graph, search_index, unit_rows

KIND = "vec_id long, embedding array<float>, shard string, score double"


def search(spark, rows, every=5, broadcast_bytes=64 << 20, **kw):
    table = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", 0.0) for i, v in rows], KIND)
    index, shards = build_index(table, **kw)
    queries = table.where(f"vec_id % {every} = 0").selectExpr("vec_id AS query_id", "cast(embedding AS array<double>) AS vector").dropDuplicates()
    return search_index(index, shards, queries, broadcast_bytes=broadcast_bytes).collect()


def exact(rows, query, k=5):
    by = dict(rows)
    q = np.asarray(by[query], dtype=np.float32).astype(float)
    found = []
    for i, v in rows:
        v = np.asarray(v, dtype=np.float32).astype(float)
        if i != query and len(v) == len(q):
            found.append((-round(float(v @ q / np.sqrt((v @ v) * (q @ q))), 9), i))
    return [i for _, i in sorted(found)[:k]]


def test_recall_over_shards(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 24)))]
    got = {}
    for r in search(spark, rows, 25, shard_bytes=400 * 24 * 8):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hits = sum(len({v for _, v in got[q]} & set(exact(rows, q))) for q in got)
    assert len(got) == 60 and hits >= 0.95 * 300
    assert all(sorted(k for k, _ in g) == [1, 2, 3, 4, 5] for g in got.values())


def test_ties_and_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(i, [1.0, float(i), 0.0]) for i in range(41, 60)]
    got = {}
    for r in search(spark, rows, 10, shard_bytes=15 * 24):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    assert [v for _, v, _ in sorted(got[10])] == [0, 1, 2, 3, 4]
    assert [v for _, v, _ in sorted(got[0])] == [1, 2, 3, 4, 5]


def test_blocks_of_queries_give_what_a_broadcast_gives(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(600, 8)))]
    key = lambda got: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in got)
    assert key(search(spark, rows, 25, shard_bytes=200 * 64)) == key(search(spark, rows, 25, broadcast_bytes=0, shard_bytes=200 * 64))


def test_inserted_graph_finds_clusters():
    rng = np.random.default_rng(3)
    x = unit_rows(np.repeat(rng.normal(size=(30, 32)), 150, 0) + 0.3 * rng.normal(size=(4500, 32)))
    levels, entry = build_graph(x, batch=256)
    assert [len(m) for m, _ in levels] == sorted((len(m) for m, _ in levels), reverse=True) and len(levels[0][0]) == 4500
    q = x[::45]
    got = search_graph(x, levels, entry, q)
    want = np.argsort(-(q @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(got, want, strict=True)]) >= 0.97


def test_unusable_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (5, [0.0, 1.0]), (6, None), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, []), (12, [1.0, 1.0, 1.0]), (15, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in search(spark, rows))
    assert got == [(0, 1, 5), (5, 1, 0), (15, 1, 12)]
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0])]) == []


def test_a_stored_graph_is_the_one_that_was_built():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8_000, 6))
    rows = pa.table({"shard": pa.array(["6/0"] * len(x)), "vec_id": pa.array(range(len(x)), pa.int64()), "vector": pa.array(list(x), pa.list_(pa.float64()))})
    stored = _build(24, 48)(rows)
    assert [f"{n} {t}" for n, t in zip(stored.schema.names, ("string", "int", "int", *["binary"] * 6), strict=True)] == INDEX.split(", ")
    vectors, ids, starts, levels, entry = load_graph(stored.to_pylist()[0])
    built, first = build_graph(unit_rows(vectors))
    assert len(levels) == len(built) >= 3 and entry == first
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(levels, built, strict=True))
    assert sorted(ids) == list(range(len(x))) and (np.diff(starts) == 1).all() and (vectors[np.argsort(ids)] == x).all()
    unit = unit_rows(vectors)
    q = unit[::160]
    got, want = search_graph(unit, levels, entry, q), np.argsort(-(q @ unit.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(got, want, strict=True)]) >= 0.97


def test_the_query_finds_the_nearest_of_the_whole_table(spark):
    for size in ("sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").toPandas()
        ids, unit = rows["vec_id"].to_numpy(), unit_rows(np.stack(rows["embedding"]).astype(float))
        got = {}
        for r in op2_hnsw(spark, f"/root/testdata/{size}").collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        asked = np.flatnonzero(ids % 50 == 0)
        assert sorted(got) == sorted(ids[asked])
        near = unit[asked] @ unit.T
        near[np.arange(len(asked)), asked] = -2
        want = ids[np.lexsort((np.broadcast_to(ids, near.shape), -near.round(12)), axis=1)[:, :5]]
        hits = sum(len(set(w) & set(got[q].values())) for q, w in zip(ids[asked], want, strict=True))
        assert hits >= 0.95 * want.size and all(len(g) == 5 for g in got.values())


def test_repeated_ids_are_one_query_and_one_candidate(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [0.0, 2.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in search(spark, rows))
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.707107)]
