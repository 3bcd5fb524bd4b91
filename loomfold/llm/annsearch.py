"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

Rows are dealt to shards of bounded bytes by a hash of their id. A shard's distinct vectors get geometric levels and are
inserted highest first, in batches: each walks the graph so far and is linked with up to ``degree`` neighbours picked from
its nearest finds by the diversity rule, and a vector keeps the ``degree`` nearest of those that link with it besides.
Neighbours are flat integer arrays, padded with -1, stored with the vectors as one row for each shard in the shared folder.

Queries walk every shard's graph, greedily down the levels, then with a beam on the ground level, a block of queries
stepping together. Identical vectors are one node with the list of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize


def _usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(vectors):
    """Rows over their length, in double precision, safe from overflow."""
    import numpy as np

    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def diverse(near, value, vectors, degree: int):
    """Up to ``degree`` of each row's candidates, sorted nearest first (-1 for none): one that is nearer to a picked candidate than to the row is skipped; room that is left goes to the nearest skipped."""
    import numpy as np

    k = near.shape[1]
    x = vectors[near]
    between = np.einsum("rkd,rjd->rkj", x, x, optimize=True)
    picked = np.zeros(near.shape, dtype=bool)
    for j in range(k):
        blocked = (picked & (between[:, :, j] > value[:, j : j + 1])).any(1)
        picked[:, j] = (near[:, j] >= 0) & ~blocked & (picked.sum(1) < degree)
    rank = np.argsort(np.where(picked, np.arange(k), k + np.arange(k)), axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(near, rank, 1)


class Level:
    """The links of one level while rows are inserted: own links picked by diversity, and the nearest of those that point here."""

    def __init__(self, n: int, degree: int):
        import numpy as np

        self.own = np.full((n, degree), -1, dtype=np.int32)
        self.back = np.full((n, degree), -1, dtype=np.int32)
        self.back_value = np.full((n, degree), -2, dtype=np.float32)

    def insert(self, x, rows, near, value) -> None:
        """Link the rows with their candidates, and the candidates back with them."""
        import numpy as np

        degree = self.own.shape[1]
        for at in range(0, len(rows), 256):
            part = slice(at, at + 256)
            picked = diverse(near[part], value[part], x, degree)
            self.own[rows[part], : picked.shape[1]] = picked
        to, of = self.own[rows].ravel(), np.repeat(rows, degree)
        of, to = of[to >= 0], to[to >= 0]
        touched, place = np.unique(to, return_inverse=True)
        # those that point here already, and the new ones: the nearest stay
        old = self.back[touched].ravel()
        where = np.concatenate([np.repeat(np.arange(len(touched)), degree)[old >= 0], place])
        who = np.concatenate([old[old >= 0], of])
        how = np.concatenate([self.back_value[touched].ravel()[old >= 0], np.einsum("nd,nd->n", x[of], x[to])]).astype(np.float32)
        order = np.lexsort((who, -how, where))
        where, who, how = where[order], who[order], how[order]
        rank = np.arange(len(where)) - np.searchsorted(where, where)
        keep = rank < degree
        self.back[touched], self.back_value[touched] = -1, -2
        self.back[touched[where[keep]], rank[keep]] = who[keep]
        self.back_value[touched[where[keep]], rank[keep]] = how[keep]

    def links(self):
        import numpy as np

        return np.concatenate([self.own, self.back], 1)


def nearest_of(found, sims, pool: int):
    """The ``pool`` nearest candidates, nearest first; repeats and -1 go to the end."""
    import numpy as np

    order = np.argsort(found, axis=1, kind="stable")
    found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
    sims[:, 1:][found[:, 1:] == found[:, :-1]] = -2
    sims[found < 0] = -2
    order = np.argsort(-sims, axis=1, kind="stable")[:, :pool]
    found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims > -2, found, -1), sims


def build_graph(unit, degree: int = 24, pool: int = 48, seed: int = 7, batch: int = 1024):
    """(levels, entry): for each level the members and the flat neighbour array; level 0 holds all rows.

    Rows have geometric heights and enter highest first. A level is filled in batches: each row walks the levels above and
    what this level has so far, and is compared with its own batch besides; so building a shard takes about as many
    comparisons for each row as searching it.
    """
    import numpy as np

    n = len(unit)
    rng = np.random.default_rng(seed)
    height = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 8)
    order = np.lexsort((rng.random(n), -height))
    x = unit.astype(np.float32)
    levels: list = []
    for level in range(int(height.max(initial=0)), -1, -1):
        members = order[: np.count_nonzero(height >= level)]
        own, size = Level(n, degree), 0
        while size < len(members):
            # what is there should outnumber a batch, or its rows would mostly meet each other
            rows = members[size : size + min(batch, max(128, size))]
            q = x[rows]
            sims = q @ q.T
            np.fill_diagonal(sims, -2)
            k = min(pool, len(rows))
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            found, value = rows[near], np.take_along_axis(sims, near, 1)
            if size:
                walked = search_graph(unit, [(members[:size], own.links()), *levels], int(order[0]), q, pool)
                found = np.concatenate([found, walked], 1)
                value = np.concatenate([value, np.where(walked >= 0, np.einsum("qkd,qd->qk", x[walked], q), -2)], 1)
            found, value = nearest_of(found, value.astype(np.float32), pool)
            own.insert(x, rows, found, value)
            size += len(rows)
        levels.insert(0, (np.sort(members).astype(np.int32), own.links()))
    return [(m, links[m]) for m, links in levels], int(order[0]) if n else -1


def search_graph(unit, levels, entry: int, queries, beam: int = 200):
    """Row numbers of up to ``beam`` near vectors of each query, -1 where there are none; all queries step together."""
    import numpy as np

    n, m = len(unit), len(queries)
    x, q = unit.astype(np.float32), queries.astype(np.float32)
    at = np.full(m, entry)
    best = np.einsum("qd,qd->q", x[at], q)
    for members, links in reversed(levels[1:]):
        place = np.arange(n)
        if len(links) < n:
            place[members] = np.arange(len(members))
        moving = np.arange(m)
        while len(moving):
            near = links[place[at[moving]]]
            sims = np.where(near >= 0, np.einsum("qkd,qd->qk", x[near], q[moving]), -2)
            j = sims.argmax(1)
            top = sims[np.arange(len(moving)), j]
            better = top > best[moving]
            moving, j, top, near = moving[better], j[better], top[better], near[better]
            at[moving], best[moving] = near[np.arange(len(moving)), j], top
    links = levels[0][1]
    width = min(beam, n)
    found, sims, open_ = np.full((m, width), -1), np.full((m, width), -2.0, dtype=np.float32), np.zeros((m, width), dtype=bool)
    found[:, 0], sims[:, 0], open_[:, 0] = at, best, True
    seen = np.zeros((m, n + 1), dtype=bool)  # the last column takes what -1 points at
    seen[np.arange(m), at] = True
    seen[:, n] = True
    while True:
        value = np.where(open_, sims, -3)
        steps = min(4, width)  # so many open ones of each query are expanded at once
        pick = np.argpartition(-value, steps - 1, axis=1)[:, :steps] if width > steps else np.tile(np.arange(width), (m, 1))
        ok = np.take_along_axis(value, pick, 1) > -3
        active = np.flatnonzero(ok.any(1))
        if not len(active):
            return found
        pick, ok = pick[active], ok[active]
        flags = open_[active]
        np.put_along_axis(flags, pick, False, 1)
        open_[active] = flags
        near = links[found[active[:, None], pick]]
        near = np.where(ok[:, :, None], near, -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[active[:, None], near]] = -1
        seen[active[:, None], near] = True
        got = np.where(near >= 0, np.einsum("qkd,qd->qk", x[near], q[active]), -2).astype(np.float32)
        all_found = np.concatenate([found[active], near], 1)
        all_sims = np.concatenate([sims[active], got], 1)
        all_open = np.concatenate([open_[active], near >= 0], 1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        found[active] = np.take_along_axis(all_found, keep, 1)
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        open_[active] = np.take_along_axis(all_open, keep, 1) & (found[active] >= 0)


def _vectors(column):
    """The list column as a two-dimensional double array."""
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _build(degree: int, pool: int):
    def run(table):
        import numpy as np
        import pyarrow as pa

        vectors, ids = _vectors(table.column("vector")), table.column("vec_id").to_numpy()
        distinct, node = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, node.ravel()))
        starts = np.searchsorted(node.ravel()[order], np.arange(len(distinct) + 1))
        levels, entry = build_graph(unit_rows(distinct), degree, pool)
        sizes = np.array([len(m) for m, _ in levels], dtype=np.int32)
        members = np.concatenate([m for m, _ in levels])
        links = np.concatenate([x.ravel() for _, x in levels])
        blob = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
        return pa.table({
            "shard": table.column("shard")[:1], "dims": pa.array([distinct.shape[1]], pa.int32()), "entry": pa.array([entry], pa.int32()),
            "vectors": blob(distinct, "<f8"), "ids": blob(ids[order], "<i8"), "starts": blob(starts, "<i8"), "sizes": blob(sizes, "<i4"), "members": blob(members, "<i4"), "links": blob(links, "<i4"),
        })

    return run


INDEX = "shard string, dims int, entry int, vectors binary, ids binary, starts binary, sizes binary, members binary, links binary"


def load_graph(row: dict):
    """(vectors, ids, starts, levels, entry) from a stored row; all levels have the same number of neighbours for each member."""
    import numpy as np

    vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dims"])
    members, links = np.frombuffer(row["members"], "<i4"), np.frombuffer(row["links"], "<i4")
    links = links.reshape(len(members), -1)
    levels, at = [], 0
    for size in np.frombuffer(row["sizes"], "<i4"):
        levels.append((members[at : at + size], links[at : at + size]))
        at += size
    return vectors, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["starts"], "<i8"), levels, row["entry"]


def _answers(row: dict, wanted, asked, k: int, beam: int, out: dict) -> None:
    """Append the k nearest of each query in one shard: the walk's finds, measured again on the vectors as they came."""
    import numpy as np

    vectors, ids, starts, levels, entry = load_graph(row)
    unit = unit_rows(vectors)
    for at in range(0, len(asked), 256):
        q = unit_rows(asked[at : at + 256])
        nodes = search_graph(unit, levels, entry, q, max(beam, 2 * (k + 1)))
        exact = (unit[nodes] * q[:, None, :]).sum(2)
        exact[nodes < 0] = -9
        for j in range(len(q)):
            own, found = wanted[at + j], []
            for c in np.argsort(-exact[j], kind="stable"):
                if nodes[j, c] < 0 or len(found) >= k and exact[j, c] < found[k - 1][0]:
                    break
                same = ids[starts[nodes[j, c]] : starts[nodes[j, c] + 1]][: k + 1]
                found += [(exact[j, c], v) for v in same if v != own]
            found.sort(key=lambda x: (-x[0], x[1]))
            for score, v in found[:k]:
                out["query_id"].append(int(own))
                out["vec_id"].append(int(v))
                out["score"].append(float(score))


def _found(out: dict):
    import pyarrow as pa

    return [pa.array(out["query_id"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64())]


FOUND = ["query_id", "vec_id", "score"]


def _search(k: int, beam: int):
    """A shard's graph and a block of queries that were exchanged to it."""

    def run(index, queries):
        import pyarrow as pa

        out: dict = {c: [] for c in FOUND}
        if queries.num_rows:
            wanted, asked = queries.column("query_id").to_numpy(), _vectors(queries.column("vector"))
            for i in range(index.num_rows):
                _answers({c: index.column(c)[i].as_py() for c in index.column_names}, wanted, asked, k, beam, out)
        return pa.Table.from_arrays(_found(out), names=FOUND)

    return run


def _search_all(queries, k: int, beam: int):
    """Every shard's graph where it lies, against broadcast queries by length: {dims: (ids, vectors)}."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(k_)[i].as_py() for k_, c in enumerate(b.schema.names)}
                out: dict = {c: [] for c in FOUND}
                if row["dims"] in queries.value:
                    _answers(row, *queries.value[row["dims"]], k, beam, out)
                yield pa.RecordBatch.from_arrays(_found(out), names=FOUND)

    return run


def build_index(table: DataFrame, shard_bytes: int = 8 << 20, degree: int = 24, pool: int = 48, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """One stored row for each shard, and the number of shards.

    A shard's vectors take about ``shard_bytes`` in double precision, so their number depends on their length. Vectors of
    different lengths are never in one shard, and rows that cannot take part are left out; an empty table gives no shard.
    The index stays in the shared folder until the application ends.
    """
    own = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    size = own.agg(F.sum(8 * F.size("vector").cast("long")).alias("s")).first()["s"] or 0
    shards = max(1, -(-size // shard_bytes))
    # a salt beside the id: rows that repeat an id don't all meet in one shard
    place = F.pmod(F.xxhash64("vec_id", F.xxhash64("vector"), F.monotonically_increasing_id()), F.lit(shards))
    keyed = own.withColumn("shard", F.concat_ws("/", F.size("vector").cast("string"), place.cast("string")))
    return materialize(keyed.groupBy("shard").applyInArrow(_build(degree, pool), INDEX), "graphs"), shards


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int = 5, beam: int = 200, block_rows: int = 20_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query (query_id long, vector array<double>).

    Ties go to the smaller id; equal vectors are one node whose ids all stand for it, and of a tie between vectors that differ
    only by a factor those within the walk's beam are seen. Queries without a usable vector give no rows, as do an empty
    index and queries of a length that no vector has.

    Queries of at most ``broadcast_bytes`` go to the graphs, which stay where they lie; more are dealt to blocks of about
    ``block_rows``, and each block and shard is one task of bounded size.
    """
    import pyarrow.compute as pc

    spark = queries.sparkSession
    usable = queries.where(F.col("query_id").isNotNull() & _usable(F.col("vector"))).select("query_id", "vector")
    sizes = usable.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(8 * F.size("vector").cast("long") + 8), F.lit(0)).alias("s")).first()
    if sizes["s"] <= broadcast_bytes:
        held = usable.select("query_id", "vector", F.size("vector").alias("dims")).toArrow()  # bounded by the check above
        own = {n: held.filter(pc.equal(held.column("dims"), n)).combine_chunks() for n in pc.unique(held.column("dims")).to_pylist()}
        asked = spark.sparkContext.broadcast({n: (t.column("query_id").to_numpy(), _vectors(t.column("vector"))) for n, t in own.items()})
        found = index.mapInArrow(_search_all(asked, k, beam), "query_id long, vec_id long, score double")
    else:
        blocks = max(1, -(-sizes["n"] // block_rows))
        block = F.pmod(F.xxhash64("query_id", F.xxhash64("vector")), F.lit(blocks)).cast("int")
        every = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.concat_ws("/", F.size("vector").cast("string"), i.cast("string")))
        asked = usable.select(F.explode(every).alias("shard"), block.alias("block"), "query_id", "vector")
        graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = graphs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(k, beam), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_hnsw(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all others.

    Rows that share an id are one query, answered by the nearest over its vectors; a candidate id counts once, with its
    best score.
    """
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    queries = table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).dropDuplicates()
    index, shards = build_index(table)
    return search_index(index, shards, queries)
