"""N-gram Jaccard join with adaptive multi-match prefixes.

Two texts link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct word shingles (64-bit hashes).
Texts of equal sets are one node, so exact copies never meet each other.

**Prefixes.** In one global order of tokens, a node that links with another shares at least L tokens with it within their
first ``|A| - ceil(percent * |A| / 100) + L`` tokens. The order puts the tokens of a fixed range of hashes first, rarest
first, counted over the whole corpus; a token that only one node has takes a place but no work, so most nodes are settled
by their own rare tokens. Each other node's L is the one with the least estimated cost: postings read, plus candidates to
verify, which fall with L. A pair is verified if it shares as many tokens as the smaller of its two L.

**Frequent tokens.** Tokens with more than ``hot`` postings come last in the order. Nodes that run out of others within
the first range count their remaining tokens as well; what then still needs frequent tokens is made of them almost
entirely - the members of large near-copy groups. Those are grouped by the frequent tokens in their prefixes, and each
group is resolved exactly without looking at all its pairs: see :func:`resolve_group`. Groups beyond a bounded number of
tokens are cut into blocks, and each two blocks meet in a task of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, bounded_batches, broadcast_if_small, release

CACHE_WORDS = 100_000


def allowed_prefix(size: int, percent: int) -> int:
    """Tokens of which at least one must be shared with any linked set."""
    return size - -(-size * percent // 100) + 1


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text's UTF-8 bytes, A-Z lower-cased."""

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def of(self, text: bytes | None):
        import numpy as np
        import xxhash

        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = self.n if len(h) >= self.n else len(h)
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return np.unique(out)


def _sets(n: int, cut: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        shingler = Shingler(n)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sizes, firsts, nodes, tokens = [], [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    own = shingler.of(text)
                    data = own.astype("<u8").tobytes()
                    sizes.append(len(own))
                    firsts.append(int(np.searchsorted(own, np.uint64(cut))))
                    nodes.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
                    tokens.append(data)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(firsts, pa.int32()), pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], names=["doc_id", "size", "first", "node", "tokens"])

    return run


def _heavy(hot: int, chunk: int = 4096, share: int = 64):
    """(token, n) of tokens that more than ``hot`` and at least a 64th of the sets in a chunk have."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def counted(sets: list):
            tokens, n = np.unique(np.frombuffer(b"".join(sets), "<i8"), return_counts=True)
            often = n >= max(hot + 1, len(sets) // share)
            return pa.RecordBatch.from_arrays([pa.array(tokens[often]), pa.array(n[often].astype("int64"))], names=["token", "n"])

        sets, size = {}, 0
        for b in batches:
            for node, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node not in sets:
                    sets[node] = data
                    size += len(data)
                if len(sets) == chunk or size > 1 << 22:
                    yield counted(list(sets.values()))
                    sets, size = {}, 0
        if sets:
            yield counted(list(sets.values()))

    return run


def heavy_tokens(usable: DataFrame, nodes: int, hot: int):
    """Sorted tokens that surely are in more than ``hot`` sets and in at least a 1024th of them: so at most 1024 times the mean size.

    They need no count, so their postings can be dealt out as one likes.
    """
    import numpy as np

    found = usable.select("node", "tokens").mapInArrow(_heavy(hot), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["token"] for r in found.where(F.col("n") >= max(hot + 1, nodes // 1024)).select("token").collect()), dtype=np.int64)


def _emit(from_first: bool, heavy):
    """(token, node, salt) of the tokens in the first range, or of those beyond it; copies within a batch once. Heavy tokens have a salt above 0."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = heavy.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                kept, counts, nodes, seen = [], [], [], set()
                for node, first, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if node not in seen:
                        seen.add(node)
                        own = data[: 8 * first] if from_first else data[8 * first :]
                        kept.append(own)
                        counts.append(len(own) // 8)
                        nodes.append(node)
                tokens, owner = np.frombuffer(b"".join(kept), "<i8"), np.repeat(np.array(nodes, np.int64), counts)
                salt = np.zeros(len(tokens), dtype=np.int32)
                if len(known) and len(tokens):
                    held = known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens
                    salt[held] = 1 + (owner[held] & 0xFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(owner), pa.array(salt)], names=["token", "node", "salt"])

    return run


def _shared_tokens(rows: DataFrame, hot: int) -> DataFrame:
    """(node, found): for each node its tokens that another node has too, with their number of postings.

    One exchange by token gives both the count and its rows. Heavy tokens count as one more than ``hot``, whatever they have.
    """
    w = Window.partitionBy("token", "salt")
    counted = rows.select("token", "node", "salt", F.count(F.lit(1)).over(w).cast("int").alias("n"), F.min("node").over(w).alias("a"), F.max("node").over(w).alias("b"))
    several = counted.where("salt > 0 or a <> b").select("node", "token", F.when(F.col("salt") > 0, F.lit(hot + 1)).otherwise(F.col("n")).alias("df"))
    return several.groupBy("node").agg(F.collect_set(F.struct("df", "token")).alias("found"))


def choose_matches(size: int, base: int, postings: list[int], most: int = 4) -> int:
    """L with the least estimated cost: postings read, and candidates (which need L of them each) times the set's size / 64."""
    best, cheapest, run = 1, None, sum(postings[:base])
    for matches in range(1, min(most, len(postings) - base + 1) + 1):
        if matches > 1:
            run += postings[base + matches - 2]
        cost = run + run / matches * size / 64
        if cheapest is None or cost < cheapest:
            best, cheapest = matches, cost
    return best


def _prefixes(percent: int, hot: int):
    """Rows (token, rep, size, matches, frequent) of each node's prefix, without tokens that no other node has."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(value):
            if value is None or not value.is_valid:
                return np.zeros((0, 2), np.int64)
            v = value.values
            return np.stack([v.field(0).to_numpy().astype(np.int64), v.field(1).to_numpy()], 1)

        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for i in range(b.num_rows):
                rep, size, first = (b.column(k)[i].as_py() for k in range(3))
                near, beyond, whole = pairs(b.column(3)[i]), pairs(b.column(4)[i]), b.column(5)[i].as_py()
                need = allowed_prefix(size, percent)
                order = lambda x: x[np.lexsort((x[:, 1], x[:, 0]))]
                lone = first - len(near)
                rare, often = order(near[near[:, 0] <= hot]), near[near[:, 0] > hot]
                ranked = [rare]
                if whole:  # the tokens beyond the first range are counted too
                    alone = size - first - len(beyond)
                    ranked += [np.zeros((alone, 2), np.int64), order(beyond[beyond[:, 0] <= hot])]
                    often = np.concatenate([often, beyond[beyond[:, 0] > hot]])
                line = np.concatenate(ranked)
                take, places = max(0, need - lone), len(line)
                matches = choose_matches(size, take, line[:, 0].tolist()) if take and places > take else 1
                own = line[: take + matches - 1]
                own = own[own[:, 0] > 0]
                rows = [(t, False) for t in own[:, 1].tolist()]
                if take > places:
                    rows += [(t, True) for t in np.sort(often[:, 1])[: take - places].tolist()]
                for t, frequent in rows:
                    for c, v in zip(out, (t, rep, size, matches, frequent), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["token", "rep", "size", "matches", "frequent"])

    return run


def _pairs(percent: int):
    """(a, b, shared, matches) of each posting list, with the number of tokens that have this list."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for members, shared in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, x in enumerate(members):
                    for y in members[i + 1 :]:
                        if 100 * min(x["size"], y["size"]) >= percent * max(x["size"], y["size"]):
                            for c, v in zip(out, (min(x["rep"], y["rep"]), max(x["rep"], y["rep"]), shared, min(x["matches"], y["matches"])), strict=True):
                                c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["a", "b", "shared", "matches"])

    return run


def _verify(percent: int):
    """The pairs that link, their documents and weights, and whether a group counts the pair."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            where = pa.array(np.flatnonzero(keep))
            names = ["a", "b", "a_doc", "b_doc", "a_rows", "b_rows", "grouped"]
            yield pa.RecordBatch.from_arrays([b.column(n).take(where) for n in names], names=names)

    return run


def resolve_group(ids, sets, percent: int) -> list[tuple[int, int]]:
    """Links enough to connect what is connected within the group; ``sets`` are sorted arrays of tokens.

    Let D(x) be the tokens in which x differs from a pivot p, and c = (100 - percent) / (100 + percent), so x and y link
    when ``|D(x) ^ D(y)| <= c * (|x| + |y|)``. Members that link with p are connected through it and aren't compared with
    each other. A member near p that doesn't link with it can only link with members that share a token of D with it
    (otherwise the difference would exceed c * (|x| + |y|)), and counting those shared tokens gives the exact
    difference. Members too far from p to link with anything settled here wait for a later pivot.
    """
    import numpy as np

    m = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, token = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True)
    token = token.ravel()
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(m), sizes)
    c, theta = (100 - percent) / (100 + percent), percent / 100
    far = c * sizes * (1 + 1 / theta) ** 2
    compared = far / theta + c * sizes * (1 + 1 / theta) + 1
    popular = np.bincount(token)[token]
    waiting = np.ones(m, dtype=bool)
    typical = np.array([popular[s:e].mean() if e > s else 0 for s, e in zip(starts, ends, strict=True)])
    links = []
    width = int(token.max(initial=-1)) + 1
    while waiting.any():
        alive = np.flatnonzero(waiting)
        p = int(alive[np.argmax(typical[alive])])  # the most typical one is nearest to the others
        in_p = np.zeros(width, dtype=bool)
        in_p[token[starts[p] : ends[p]]] = True
        common = np.bincount(owner[in_p[token]], minlength=m)
        diff = sizes + sizes[p] - 2 * common
        linked = waiting & (100 * common >= percent * (sizes + sizes[p] - common))
        linked[p] = False
        links += [(int(ids[p]), int(ids[x])) for x in np.flatnonzero(linked)]
        loose = waiting & ~linked & (diff <= far)
        loose[p] = False
        if loose.any():
            others = np.flatnonzero(waiting & (diff <= compared) & (np.arange(m) != p))
            pset = np.flatnonzero(in_p)
            differing = {}
            for x in others:
                own = token[starts[x] : ends[x]]
                lost = np.setdiff1d(pset, own, assume_unique=True)
                differing[x] = np.concatenate([own[~in_p[own]], lost])
            flat = np.concatenate([differing[x] for x in others])
            who = np.repeat(np.arange(len(others)), [len(differing[x]) for x in others])
            order = np.argsort(flat, kind="stable")
            flat_sorted, who_sorted = flat[order], who[order]
            for x in np.flatnonzero(loose):
                own = differing[x]
                a, b = np.searchsorted(flat_sorted, own, "left"), np.searchsorted(flat_sorted, own, "right")
                lengths = b - a
                at = np.repeat(a - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
                met = np.bincount(who_sorted[at], minlength=len(others))
                apart = diff[x] + diff[others] - 2 * met
                inter = (sizes[x] + sizes[others] - apart) // 2
                hit = (met > 0) & (100 * inter >= percent * (sizes[x] + sizes[others] - inter)) & (others != x)
                links += [(int(ids[x]), int(ids[y])) for y in others[hit]]
        waiting &= ~(linked | loose)
        waiting[p] = False
    return links


def spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that keep the components and no more."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in links:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def count_links(sets, weights, blocks, percent: int):
    """For each member the summed weights of the members that it links with, of other blocks only if there are two blocks.

    The pivots of :func:`resolve_group`, but each member near a pivot is held against all members that it may link with:
    two sets differ by ``|D(x)| + |D(y)| - 2 * |D(x) & D(y)|``, so only tokens that differ from the pivot are looked up.
    """
    import numpy as np

    m = len(sets)
    weights, blocks = np.asarray(weights, dtype=np.int64), np.asarray(blocks)
    two = len(np.unique(blocks)) > 1
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, token = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True)
    token = token.ravel()
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(m), sizes)
    c, theta = (100 - percent) / (100 + percent), percent / 100
    far = c * sizes * (1 + 1 / theta) ** 2
    compared = far / theta + c * sizes * (1 + 1 / theta) + 1
    popular = np.bincount(token)[token] if m else token
    typical = np.array([popular[s:e].mean() if e > s else 0 for s, e in zip(starts, ends, strict=True)])
    width = int(token.max(initial=-1)) + 1
    waiting, out = np.ones(m, dtype=bool), np.zeros(m, dtype=np.int64)
    while waiting.any():
        alive = np.flatnonzero(waiting)
        p = int(alive[np.argmax(typical[alive])])
        in_p = np.zeros(width, dtype=bool)
        in_p[token[starts[p] : ends[p]]] = True
        diff = sizes + sizes[p] - 2 * np.bincount(owner[in_p[token]], minlength=m)
        near = waiting & (diff <= far)
        near[p] = True
        others = np.flatnonzero(waiting & ((diff <= compared) | near))
        pset = np.flatnonzero(in_p)
        differing = []
        for x in others:
            own = token[starts[x] : ends[x]]
            differing.append(np.concatenate([own[~in_p[own]], np.setdiff1d(pset, own, assume_unique=True)]))
        flat = np.concatenate(differing)
        who = np.repeat(np.arange(len(others)), [len(d) for d in differing])
        order = np.argsort(flat, kind="stable")
        flat_sorted, who_sorted = flat[order], who[order]
        stays = ~near[others]
        for k in np.flatnonzero(~stays):
            x, own = others[k], differing[k]
            a, b = np.searchsorted(flat_sorted, own, "left"), np.searchsorted(flat_sorted, own, "right")
            lengths = b - a
            at = np.repeat(a - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            apart = diff[x] + diff[others] - 2 * np.bincount(who_sorted[at], minlength=len(others))
            inter = (sizes[x] + sizes[others] - apart) // 2
            hit = 100 * inter >= percent * (sizes[x] + sizes[others] - inter)
            hit[k] = False
            if two:
                hit &= blocks[others] != blocks[x]
            out[x] += weights[others[hit]].sum()
            out[others[hit & stays]] += weights[x]  # those never come to look at x themselves
        waiting &= ~near
    return out


def _resolve(percent: int, count: bool):
    """Links (a, b) of documents that keep a cell's components and, where asked, rows (rep, links) of its counts."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        ids, docs = table.column("rep").to_pylist(), table.column("doc").to_pylist()
        sets = [np.frombuffer(x, "<u8") for x in table.column("tokens").to_pylist()]
        links = spanning(resolve_group(docs, sets, percent))
        n, m = len(links), 0
        counts = np.zeros(0, np.int64)
        first, last = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        blocks = table.column("at").to_numpy()
        # the pairs within a block are counted where it meets itself
        if count and (first == last or len(np.unique(blocks)) > 1):
            counts = count_links(sets, table.column("rows").to_pylist(), blocks, percent)
            m = len(ids)
        pad = lambda x, before, after: pa.array([None] * before + list(x) + [None] * after, pa.int64())
        return pa.table({"a": pad([x for x, _ in links], 0, m), "b": pad([y for _, y in links], 0, m), "rep": pad(ids[:m], n, 0), "links": pad(counts.tolist(), n, 0)})

    return run


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, hot: int = 16, block_tokens: int = 2_000_000, reach: float = 1.4, links: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for every row and, with ``links``, ``n_links``.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest reachable by links. Texts with fewer
    than ``words`` words are one shingle of all their words; null texts and texts without words have none and link with
    nothing. Rows that repeat an id are one document whose sets' links are joined. Rows with a null id are judged but
    never name a class: alone, their ids stay null. An empty table gives no rows. Texts of any length are read whole; a text's
    shingles are in memory at once. Sets at exactly ``percent`` link. Further columns, whatever their names, aren't read.

    ``n_links`` is the number of other rows with an id whose set links with this row's, equal sets included; it is null for
    rows with a null id. In groups made of frequent tokens all pairs are counted, each in one cell of blocks.

    The result is a table of five numbers a row in the shared folder; all else is deleted as it goes.

    ``reach`` sets the first range of hashes: that many times the share of tokens a prefix needs. Results don't depend on
    it. A wider range settles more nodes by their own rare tokens and counts more; shingles of five words are rare enough
    for a narrow one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with Scratch(spark) as scratch:
        named = _named(scratch, docs, words, percent, hot, block_tokens, min(1.0, reach * (100 - percent) / 100), links, text, doc_id)
        out = [
            "doc_id",
            F.col("size").cast("long").alias("n_shingles"),
            F.when(F.col("size") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
            F.when(F.col("size") > 0, F.coalesce("component", "class", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ]
        if links:
            out.append(F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).alias("n_links"))
        return scratch.table(named.select(*out), "classes", keep=True)


def _open_nodes(scratch: Scratch, usable: DataFrame, nodes: DataFrame, percent: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that their own tokens in the first range don't settle, and the prefixes of these."""
    heavy = scratch.spark.sparkContext.broadcast(heavy_tokens(usable, nodes.count(), hot))
    near = _shared_tokens(usable.select("node", "first", "tokens").mapInArrow(_emit(True, heavy), "token long, node long, salt int"), hot)
    need = F.expr(f"size - cast((size * {percent}L + 99) div 100 as int) + 1")
    listed = lambda c: F.size(F.coalesce(c, F.array().cast("array<struct<df:int,token:bigint>>")))
    open_ = nodes.join(near, "node", "left").where((F.col("first") - listed(F.col("found"))) < need)
    open_ = scratch.table(open_.select(F.col("rep").alias("doc"), "rows", "node", "size", "first", F.col("found").alias("near"), need.alias("need")), "open")
    release(scratch.spark)

    rare = F.col("first") - listed(F.filter("near", lambda x: x["df"] > hot))
    short = open_.where(rare < F.col("need")).select("node")
    beyond = _shared_tokens(usable.select("node", "first", "tokens").join(broadcast_if_small(short), "node", "left_semi").mapInArrow(_emit(False, heavy), "token long, node long, salt int"), hot)
    whole = open_.join(beyond.withColumnRenamed("found", "beyond"), "node", "left").select(F.col("node").alias("rep"), "size", "first", "near", "beyond", (rare < F.col("need")).alias("whole"))
    prefixes = scratch.table(whole.mapInArrow(_prefixes(percent, hot), "token long, rep long, size int, matches int, frequent boolean"), "prefixes")
    heavy.destroy()
    return open_.select("doc", "rows", "node", "size"), prefixes


def _named(scratch: Scratch, docs: DataFrame, words: int, percent: int, hot: int, block_tokens: int, first_share: float, links: bool, text: str, doc_id: str) -> DataFrame:
    """Each row's id and size, and of its set the smallest id (``class``), the component and the links."""
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("body"))
    sets = scratch.table(own.mapInArrow(_sets(words, int(first_share * (1 << 64)) - 1), "doc_id long, size int, first int, node long, tokens binary"), "sets")
    nodes = scratch.table(sets.where("size > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("first").alias("first"), F.count(F.lit(1)).alias("rows")), "nodes")
    usable = sets.where("size > 0 and doc_id is not null").select("doc_id", "node", "first", "tokens")
    open_, prefixes = _open_nodes(scratch, usable, nodes, percent, hot)
    release(scratch.spark)

    postings = prefixes.where("not frequent").groupBy("token").agg(F.sort_array(F.collect_set(F.struct("rep", "size", "matches"))).alias("members")).where(F.size("members") > 1)
    lists = postings.groupBy("members").agg(F.count(F.lit(1)).alias("shared"))
    met = lists.mapInArrow(_pairs(percent), "a long, b long, shared long, matches int")
    candidates = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("matches").alias("matches")).where("shared >= matches and a <> b").select("a", "b")
    candidates = scratch.table(candidates, "pairs")

    frequent = prefixes.where("frequent").select("rep", "token")
    heads = frequent.groupBy("token").agg(F.min("rep").alias("b"))
    grouped = connected_components(scratch, frequent.join(heads, "token").select(F.col("rep").alias("a"), "b"), "frequent")

    wanted = candidates.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(grouped.select(F.col("id").alias("rep"))).distinct()
    wanted = wanted.join(grouped.select(F.col("id").alias("rep"), F.col("component").alias("g")), "rep", "left")
    wanted = scratch.table(wanted.join(open_.withColumnRenamed("node", "rep"), "rep"), "wanted")
    scratch.free("open", "prefixes")
    # one row of each node brings its tokens; more than one only where rows repeat the id
    chosen = broadcast_if_small(wanted.select(F.col("rep").alias("node"), F.col("doc").alias("doc_id"), "rows", "g"))
    held = usable.select("node", "doc_id", "tokens").join(chosen, ["node", "doc_id"]).dropDuplicates(["node"])
    held = scratch.table(held.select(F.col("node").alias("rep"), F.col("doc_id").alias("doc"), "rows", "g", "tokens"), "held")
    sets = scratch.table(sets.select("doc_id", "size", "node"), "sizes")
    scratch.free("sets")
    release(scratch.spark)

    side = lambda k, tokens: held.select(F.col("rep").alias(k), F.col("doc").alias(f"{k}_doc"), F.col("rows").alias(f"{k}_rows"), F.col("g").alias(f"{k}_g"), F.col("tokens").alias(tokens))
    checked = candidates.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("grouped", F.coalesce(F.col("a_g") == F.col("b_g"), F.lit(False)))
    plain = checked.select("a", "b", "a_doc", "b_doc", "a_rows", "b_rows", "grouped", "x", "y").mapInArrow(_verify(percent), "a long, b long, a_doc long, b_doc long, a_rows long, b_rows long, grouped boolean")
    plain = scratch.table(plain, "plain")
    scratch.free("pairs")

    member = grouped.select(F.col("id").alias("rep"), F.col("component").alias("g")).join(wanted.select("rep", "size"), "rep")
    blocks = member.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / F.lit(block_tokens)).cast("int")).alias("blocks"))
    placed = member.join(blocks, "g").withColumn("at", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meeting = placed.select("rep", "g", "at", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("at", j).alias("i"), F.greatest("at", j).alias("j")))).alias("cell"))
    in_cells = meeting.select("rep", "g", "at", "cell.i", "cell.j").join(held.drop("g"), "rep")
    inside = scratch.table(in_cells.groupBy("g", "i", "j").applyInArrow(_resolve(percent, links), "a long, b long, rep long, links long"), "inside")
    scratch.free("held", "wanted")

    edges = plain.select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")).unionByName(inside.where("a is not null").select("a", "b"))
    found = connected_components(scratch, edges, "links")
    named = nodes.select("node", "rep", "rows").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("node", F.col("rep").alias("class"), "rows", "component")
    if links:
        pairs = plain.where("not grouped").select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b_rows").alias("links")), F.struct(F.col("b").alias("node"), F.col("a_rows").alias("links")))).alias("e")).select("e.*")
        counts = pairs.unionByName(inside.where("rep is not null").select(F.col("rep").alias("node"), "links")).groupBy("node").agg(F.sum("links").alias("links"))
        named = named.join(counts, "node", "left").withColumn("links", F.col("rows") - 1 + F.coalesce("links", F.lit(0)))
    return sets.join(named, "node", "left")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: three-word shingles, 90 of 100 in common."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90, reach=2.0, links=True)
