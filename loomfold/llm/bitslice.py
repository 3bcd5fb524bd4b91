"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers. Rows are dealt to blocks; of each block the index holds one bitmap for each component and
binary place, a bit for each row. A query's score is a sum of products of its own binary places and the slices, so it is added
up for all rows of a block at once: slices of equal weight pass full adders, three bitmaps in, a sum and a carry out, until each
weight has one. A negative component of a query takes the slices' complements, which moves all scores alike.

The k-th highest sum is read from the most significant slice downward, keeping the rows that are above for certain and those
still level. Products of low weight are left out of the sum as long as their total stays small beside the spread of the scores;
every row whose sum reaches the k-th less that total is then resolved exactly from its own bits. So results are exact, ties
included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

INDEX = "block string, dims int, rows int, bits int, low binary, ids binary, slices binary"
FOUND = "query_id long, vec_id long, score long"
#: Quantised components beyond this count as this, so that sums can be told in a long or be seen to pass it.
MOST = 1 << 62


def quantised(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of each component, x as double; null for a vector with a null or non-finite component."""
    v = vector.cast("array<double>")
    usable = vector.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(v, lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x).cast("long"), F.lit(-MOST)), F.lit(MOST))))


def numbers(column):
    """A list column of one length as a two-dimensional array of longs."""
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(flat), len(values) // max(1, len(flat)))


def sliced(values) -> tuple[int, object, object]:
    """(bits, low, slices): the columns less their least value, as bitmaps ``[column, place, word]``, row 0 in the lowest bit."""
    import numpy as np

    rows, dims = values.shape
    low = values.min(0) if dims else np.empty(0, np.int64)
    above = (values - low).astype(np.uint64)
    bits = max(1, int(above.max(initial=0)).bit_length())
    out = np.zeros((dims, bits, -(-rows // 64) * 8), dtype=np.uint8)
    for i in range(bits):
        packed = np.packbits(((above >> np.uint64(i)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, i, : packed.shape[1]] = packed
    return bits, low, out.view("<u8")


def added(stacks: list) -> list:
    """One bitmap for each weight from lists of bitmaps ``[n, word]`` of each weight, lowest first: their sum in binary."""
    import numpy as np

    out, w = [], 0
    while w < len(stacks):
        stack = stacks[w]
        while len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                both = a ^ b
                total, carry, rest = both ^ c, (a & b) | (both & c), stack[3 * n :]
            else:
                total, carry, rest = stack[:1] ^ stack[1:2], stack[:1] & stack[1:2], stack[2:]
            stack = np.concatenate([total, rest])
            if w + 1 == len(stacks):
                stacks.append(carry)
            else:
                stacks[w + 1] = np.concatenate([stacks[w + 1], carry])
        out.append(stack[0] if len(stack) else None)
        w += 1
    return out


def highest(slices: list, rows, k: int) -> int:
    """The k-th highest sum (the least one if there are fewer rows), from the most significant slice downward; ``rows`` is the bitmap of rows that count."""
    import numpy as np

    sure, level, value = np.zeros_like(rows), rows.copy(), 0
    for s in reversed(slices):
        ones = level & s if s is not None else np.zeros_like(level)
        more = sure | ones
        value <<= 1
        if int(np.bitwise_count(more).sum()) >= k:
            level, value = ones, value | 1
        else:
            sure, level = more, level & ~ones
    return value


def reaching(slices: list, rows, least: int):
    """The bitmap of the rows whose sum is at least ``least``."""
    import numpy as np

    if least <= 0:
        return rows
    if least >> len(slices):
        return np.zeros_like(rows)
    above, level = np.zeros_like(rows), rows.copy()
    for i in reversed(range(len(slices))):
        ones = level & slices[i] if slices[i] is not None else np.zeros_like(level)
        if least >> i & 1:
            level = ones
        else:
            above, level = above | ones, level & ~ones
    return above | level


class Block:
    """A stored block, ready to be searched."""

    def __init__(self, row: dict):
        import numpy as np

        self.dims, self.rows, self.bits = row["dims"], row["rows"], row["bits"]
        self.low, self.ids = np.frombuffer(row["low"], "<i8"), np.frombuffer(row["ids"], "<i8")
        self.words = -(-self.rows // 64)
        slices = np.frombuffer(row["slices"], "<u8").reshape(self.dims, self.bits, self.words)
        #: The slices and their complements.
        self.slices = np.concatenate([slices, ~slices])
        self.all = np.full(self.words, ~np.uint64(0))
        if self.rows % 64:
            self.all[-1] = np.uint64((1 << self.rows % 64) - 1)
        # how far the components spread, to judge which weights matter
        mean = np.array([[int(np.bitwise_count(slices[d, i] & self.all).sum()) for i in range(self.bits)] for d in range(self.dims)], float).reshape(self.dims, self.bits) / max(1, self.rows)
        places = 4.0 ** np.arange(self.bits)
        self.spread = (mean * (1 - mean) * places).sum(1)

    def plan(self, query):
        """(cut, left out, products): products as (weight, row of slices, place) of weight ``cut`` and more, and the most that the others can come to."""
        import numpy as np

        size = [abs(int(x)) for x in query]
        width = max((x.bit_length() for x in size), default=0)
        ones = np.array([[x >> j & 1 for j in range(width)] for x in size], bool).reshape(self.dims, width)
        d, j = np.nonzero(ones)
        at = np.where(query[d] < 0, d + self.dims, d)
        weights = (j[:, None] + np.arange(self.bits)).ravel()
        row, place = np.repeat(at, self.bits), np.tile(np.arange(self.bits), len(at))
        by_weight = np.bincount(weights, minlength=1)
        room = 0.25 * float(np.sqrt((np.array([float(x) for x in size]) ** 2 * self.spread).sum()))
        cut, left = 0, 0
        while cut < len(by_weight) and left + (int(by_weight[cut]) << cut) <= room:
            left += int(by_weight[cut]) << cut
            cut += 1
        keep = weights >= cut
        return cut, left, (weights[keep] - cut, row[keep], place[keep])

    def values(self, rows):
        """The quantised vectors of some rows, from their bits."""
        import numpy as np

        bits = (self.slices[: self.dims, :, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        return (bits << np.arange(self.bits, dtype=np.uint64)[:, None]).sum(1, dtype=np.uint64).T.astype(np.int64) + self.low

    def search(self, query, own: int, k: int):
        """(scores, ids) of the k rows with the highest scores, highest first, ties to smaller ids; rows with the id ``own`` don't count."""
        import numpy as np

        rows = self.all
        a, b = np.searchsorted(self.ids, [own, own + 1]) if own < (1 << 63) - 1 else (np.searchsorted(self.ids, own), len(self.ids))
        if b > a:
            gone = np.zeros(self.words * 64, np.uint8)
            gone[a:b] = 1
            rows = rows & ~np.packbits(gone, bitorder="little").view("<u8")
        cut, left, (weights, at, place) = self.plan(query)
        order = np.argsort(weights, kind="stable")
        bounds = np.searchsorted(weights[order], np.arange(int(weights.max(initial=-1)) + 2))
        picked = self.slices[at[order], place[order]]
        slices = added([picked[x:y] for x, y in zip(bounds, bounds[1:], strict=False)])
        # a row left out by less than one unit of the lowest weight kept may still reach the k-th
        found = reaching(slices, rows, highest(slices, rows, k) - -(-left // (1 << cut)))
        near = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
        scores = products(self.values(near), query)
        best = np.lexsort((self.ids[near], -scores))[:k]
        return scores[best], self.ids[near][best]


def products(values, query):
    """Integer inner products as longs; one beyond a long's range is that range's end."""
    import numpy as np

    most = max((abs(int(x)) for x in query), default=0) * max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0)))) * max(1, len(query))
    if most < 1 << 62:
        return values @ query
    exact = [sum(int(x) * int(y) for x, y in zip(v, query, strict=True)) for v in values]
    return np.array([max(-(1 << 63) + 1, min((1 << 63) - 1, x)) for x in exact], dtype=np.int64)


def _build(table):
    import numpy as np
    import pyarrow as pa

    values, ids = numbers(table.column("vector")), table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    bits, low, slices = sliced(values[order])
    blob = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
    whole = lambda n: pa.array([n], pa.int32())
    return pa.table({"block": table.column("block")[:1], "dims": whole(values.shape[1]), "rows": whole(len(ids)), "bits": whole(bits), "low": blob(low, "<i8"), "ids": blob(ids[order], "<i8"), "slices": blob(slices, "<u8")})


class Best:
    """The k best finds of each query over the blocks that one task sees."""

    def __init__(self, ids, k: int):
        self.ids, self.k, self.scores, self.found = ids, k, [None] * len(ids), [None] * len(ids)

    def take(self, block: Block, queries) -> None:
        import numpy as np

        for n, (own, query) in enumerate(zip(self.ids, queries, strict=True)):
            scores, ids = block.search(query, int(own), self.k)
            if self.scores[n] is not None:
                scores, ids = np.concatenate([self.scores[n], scores]), np.concatenate([self.found[n], ids])
                best = np.lexsort((ids, -scores))[: self.k]
                scores, ids = scores[best], ids[best]
            self.scores[n], self.found[n] = scores, ids

    def batch(self):
        import numpy as np
        import pyarrow as pa

        known = [n for n in range(len(self.ids)) if self.scores[n] is not None]
        counts = [len(self.scores[n]) for n in known]
        joined = lambda rows: pa.array(np.concatenate([np.empty(0, np.int64), *(rows[n] for n in known)]).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(self.ids, np.int64)[known], counts) if known else [], pa.int64()), joined(self.found), joined(self.scores)], names=["query_id", "vec_id", "score"])


def _search_all(asked, k: int):
    """The blocks of a partition against broadcast queries by length: {dims: (ids, vectors)}."""

    def run(batches):
        best = {dims: Best(ids, k) for dims, (ids, _) in asked.value.items()}
        for b in batches:
            for i in range(b.num_rows):
                block = Block({c: b.column(n)[i].as_py() for n, c in enumerate(b.schema.names)})
                if block.dims in best:
                    best[block.dims].take(block, asked.value[block.dims][1])
        for own in best.values():
            yield own.batch()

    return run


def _search(k: int):
    """A block and a part of the queries that were exchanged to it."""

    def run(index, queries):
        import pyarrow as pa

        best = Best(queries.column("query_id").to_numpy(), k)
        for i in range(index.num_rows if queries.num_rows else 0):
            best.take(Block({c: index.column(c)[i].as_py() for c in index.column_names if c != "part"}), numbers(queries.column("vector")))
        return pa.Table.from_batches([best.batch()])

    return run


def build_index(table: DataFrame, block_rows: int = 8192, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """A stored row for each block of about ``block_rows`` rows, and the number of blocks.

    Vectors of different lengths are never in one block. Rows without an id or a usable vector are left out; an empty table
    gives no block. Rows are dealt by a hash of id, vector and place, so rows that repeat don't all meet in one block. The index
    stays in the shared folder until the application ends.
    """
    own = table.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(embedding), scale).alias("vector")).where("vec_id is not null and vector is not null")
    blocks = max(1, -(-own.count() // block_rows))
    place = F.pmod(F.xxhash64("vec_id", F.xxhash64("vector"), F.monotonically_increasing_id()), F.lit(blocks))
    keyed = own.withColumn("block", F.concat_ws("/", F.size("vector").cast("string"), place.cast("string")))
    return materialize(keyed.groupBy("block").applyInArrow(_build, INDEX), "slices"), blocks


def search_index(index: DataFrame, blocks: int, queries: DataFrame, k: int = 10, part_rows: int = 20_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query (query_id long, vector array<long>, quantised), ties to smaller ids.

    Rows with the query's own id are no candidates. Every other row is one for itself, so a candidate id that repeats may be
    found several times; rows that share a query id are asked each and ranked together. Vectors meet those of their length only;
    queries without an id or a vector give no rows. A score beyond a long is the range's end.

    Queries of at most ``broadcast_bytes`` go to the blocks, and each task hands on its k best of each; more are dealt to
    parts of about ``part_rows``, and each part and block is a task of bounded size.
    """
    import pyarrow.compute as pc

    spark = queries.sparkSession
    asked = queries.where("query_id is not null and vector is not null").select("query_id", "vector")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(8 * F.size("vector").cast("long") + 8), F.lit(0)).alias("s")).first()
    if size["s"] <= broadcast_bytes:
        held = asked.select("query_id", "vector", F.size("vector").alias("dims")).toArrow()  # bounded by the check above
        own = {n: held.filter(pc.equal(held.column("dims"), n)) for n in pc.unique(held.column("dims")).to_pylist()}
        sent = spark.sparkContext.broadcast({n: (t.column("query_id").to_numpy(), numbers(t.column("vector"))) for n, t in own.items()})
        found = index.mapInArrow(_search_all(sent, k), FOUND)
    else:
        parts = max(1, -(-size["n"] // part_rows))
        part = F.pmod(F.xxhash64("query_id", F.xxhash64("vector")), F.lit(parts)).cast("int")
        every = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.concat_ws("/", F.size("vector").cast("string"), i.cast("string")))
        dealt = asked.select(F.explode(every).alias("block"), part.alias("part"), "query_id", "vector")
        copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        found = copies.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(_search(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_bit_sliced(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all others, ten each."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    queries = table.where("vec_id % 100 = 0").select(F.col("vec_id").cast("long").alias("query_id"), quantised(F.col("embedding")).alias("vector")).dropDuplicates()
    index, blocks = build_index(table)
    return search_index(index, blocks, queries)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 100 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
placed AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
"""
