"""Packing token pieces into sequences: shortest-pack-first over the length histogram.

1. Texts become token ids and are cut into pieces of at most ``size`` ids; each piece gets its number among the pieces
   of its length in its partition.
2. The histogram of lengths (at most ``size`` bins, whatever the corpus) goes to the driver. Lengths are placed longest
   first, each into the shortest pack that holds it; packs of equal content are one *pattern* with a count, so the work
   depends on the number of bins and not on the number of documents.
3. Each pattern owns a range of ranks of each length it holds. A piece's rank is its number plus the pieces of that
   length in earlier partitions, and the rank's range gives its sequence and offset.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, bounded_batches

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, number long"
TOKENIZER = "word_bpe_49k.json"
PART_CACHE, WORD_CACHE = 200_000, 100_000


def plan_packs(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns as (count, ((length, times), ...)), longest length first.

    New packs are opened only when no pack has room, and then as many as the tokens still to be placed ask for, so short
    pieces meet in shared packs instead of opening one each.
    """
    free: dict[int, list[tuple[int, tuple]]] = {}
    heap: list[int] = []
    done: list[tuple[int, tuple]] = []
    room, todo = 0, sum(n * c for n, c in histogram.items())

    def put(space: int, count: int, pattern: tuple) -> None:
        nonlocal room
        if not space:
            done.append((count, pattern))
            return
        room += space * count
        if space not in free:
            free[space] = []
            heapq.heappush(heap, -space)
        free[space].append((count, pattern))

    def longer(pattern: tuple, length: int) -> tuple:
        if pattern and pattern[-1][0] == length:
            return (*pattern[:-1], (length, pattern[-1][1] + 1))
        return (*pattern, (length, 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = -heap[0] if heap else 0
            if space < length:
                opened = min(left, max(1, -(-(todo - room) // size)))
                put(size - length, opened, ((length, 1),))
                left -= opened
                todo -= opened * length
                continue
            count, pattern = free[space].pop()
            if not free[space]:
                del free[space]
                heapq.heappop(heap)
            room -= space * count
            taken = min(count, left)
            put(space - length, taken, longer(pattern, length))
            if count > taken:
                put(space, count - taken, pattern)
            left -= taken
            todo -= taken * length
    return done + [x for space in sorted(free) for x in free[space]]


def place_table(patterns: list[tuple[int, tuple]]):
    """Arrays that map (length, rank) to (sequence, offset), sorted by length and first rank."""
    import numpy as np

    ranks: dict[int, int] = {}
    rows, base = [], 0
    for count, pattern in patterns:
        at = 0
        for length, times in pattern:
            start = ranks.get(length, 0)
            rows.append((length, start, count, base, at))
            ranks[length] = start + count * times
            at += length * times
        base += count
    rows.sort()
    return np.array(rows, dtype="int64").reshape(-1, 5)


class WordIds:
    """Token ids of a text as little-endian 32-bit bytes, through caches of its space-separated words.

    The vocabulary drops case and white space before it forms words, and letters and punctuation never share a token. So a
    word is its letters and the marks after them; each of these meets the tokenizer once while it is cached. Caches only
    save time: one that is full becomes the older half and its forerunner goes, so frequent words stay.
    """

    MARKS = ".,!%*&#$|?;:\"()"

    def __init__(self, path: str):
        import os
        import re

        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the vocabulary takes out of a text before it forms words.
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        #: Marks and what may hold them, and the one letter below them whose lower case has a mark.
        self.composing = re.compile("[\u0300-\U0010ffff\u0130]")
        self.parts: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    @staticmethod
    def _kept(wanted: set[str], young: dict[str, bytes], old: dict[str, bytes]) -> set[str]:
        """What the older half of a cache has, moved to the younger one."""
        found = {w for w in wanted if w in old}
        for w in found:
            young[w] = old[w]
        return found

    @classmethod
    def shared(cls, path: str) -> WordIds:
        """The one of this process; a worker keeps it from task to task."""
        import sys
        import types

        kept = sys.modules.setdefault("loomfold_word_ids", types.ModuleType("loomfold_word_ids"))
        if path not in vars(kept):
            setattr(kept, path, cls(path))
        return getattr(kept, path)

    def _learn(self, parts: set[str]) -> None:
        import numpy as np

        plain = [p for p in parts if p.isalpha()]
        ids = np.array(self.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids if plain else [], dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(plain):  # each is one word of the vocabulary
            data, start = ids.tobytes(), 0
            for p, cut in zip(plain, cuts.tolist(), strict=True):
                self.parts[p] = data[4 * start : 4 * cut]
                start = cut
            plain = []
        rest = [*plain, *(p for p in parts if not p.isalpha())]
        for p, got in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False) if rest else [], strict=True):
            self.parts[p] = np.array(got.ids, dtype="<u4").tobytes()

    def of(self, text: str) -> bytes:
        from unicodedata import normalize

        if any(s in text for s in self.special):
            import numpy as np

            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        # the vocabulary composes marks before it lower-cases, and then other letters compose; below U+0300 are no marks
        if text.isascii() or not self.composing.search(text):
            text = text.lower()
        words = text.replace("\n", " ").split(" ")
        new = set(words).difference(self.words)
        if new:
            if len(self.words) + len(new) > WORD_CACHE:
                self.older_words, self.words = self.words, {}
                new = set(words)
            new -= self._kept(new, self.words, self.older_words)
            if len(self.parts) + len(new) > PART_CACHE:
                self.older_parts, self.parts = self.parts, {"": b""}
            cut = [(w, w.rstrip(self.MARKS)) for w in new]
            # letters before the marks end in a letter or a digit, also when composed, so no mark joins with what stands before
            cut = [(w, p, w[len(p) :]) if (p if p.isascii() else normalize("NFC", p).lower()).isalnum() else (w, w, "") for w, p in cut]
            missing = {x for _, p, marks in cut for x in (p, marks)}.difference(self.parts)
            missing -= self._kept(missing, self.parts, self.older_parts)
            if missing:
                self._learn(missing)
            for w, p, marks in cut:
                self.words[w] = self.parts[p] + self.parts[marks]
        return b"".join(map(self.words.__getitem__, words))


def resolve_tokenizer(name: str) -> str:
    """A vocabulary file: the path itself where this machine has it, else the installed one of that name."""
    import os

    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))


def default_tokenizer() -> str:
    """The path of the installed vocabulary."""
    return resolve_tokenizer(TOKENIZER)


def _pieces(tokenizer: str, size: int, end_id: int, with_ids: bool):
    def run(batches):
        import zlib
        from collections import Counter

        import pyarrow as pa
        from pyspark import TaskContext

        ids, part, seen = WordIds.shared(resolve_tokenizer(tokenizer)), TaskContext.get().partitionId(), Counter()
        end = end_id.to_bytes(4, "little")
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part_of = b.slice(at, 500)
                cols: list[list] = [[] for _ in range(8)]
                for doc, text in zip(part_of.column(0).to_pylist(), part_of.column(1).to_pylist(), strict=True):
                    all_ids = (ids.of(text) if text else b"") + end
                    total = len(all_ids) // 4
                    for start in range(0, total, size):
                        own = all_ids[4 * start : 4 * (start + size)]
                        n = len(own) // 4
                        for c, v in zip(cols, (doc, start, n, zlib.crc32(own), total, part, seen[n], own if with_ids else None), strict=True):
                            c.append(v)
                        seen[n] += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number", "ids"]
                k = 8 if with_ids else 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds[:k], strict=True)], names=names[:k])

    return run


def _place(table, columns: list[str]):
    def run(batches: Iterable):
        import numpy as np
        import pyarrow as pa

        rows = table.value
        keys = (rows[:, 0] << 44) | rows[:, 1]
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype("int64")
            rank = b.column(b.schema.get_field_index("rank")).to_numpy(zero_copy_only=False).astype("int64")
            own = rows[np.searchsorted(keys, (length << 44) | rank, side="right") - 1] if len(length) else rows[:0]
            time, pack = np.divmod(rank - own[:, 1], np.maximum(own[:, 2], 1))
            out = [b.column(b.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(own[:, 3] + pack), pa.array(own[:, 4] + time * length)], names=[*columns, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = 4096, end_id: int = 2, with_ids: bool = True, broadcast_rows: int = 250_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, on request, ``ids`` (little-endian 32-bit).

    ``tokenizer`` is a vocabulary whose words end at white space: a path that all machines have, or the name of an installed
    one, which each machine finds for itself. Null and empty texts have the end id only; null ids stay null; repeated rows
    are packed each; an empty table gives no rows; further columns are not read. Texts of any length are tokenized whole, and
    longer ones than ``size`` become several pieces. Pieces of equal length are interchangeable: they are dealt to packs in
    the order of partitions and of rows in them.

    A piece finds its rank by its partition and length; that table is broadcast up to ``broadcast_rows`` rows of three
    numbers, and joined by an exchange beyond. Pieces stay in the shared folder until the application ends, as the result
    reads them.
    """
    spark = docs.sparkSession
    bounded_batches(docs.sparkSession)
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("body"))
    kind = PIECE + (", ids binary" if with_ids else "")
    with Scratch(spark) as scratch:
        pieces = scratch.table(own.mapInArrow(_pieces(tokenizer, size, end_id, with_ids), kind), "pieces", keep=True)
        counts = scratch.table(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
        histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size bins at most
        table = spark.sparkContext.broadcast(place_table(plan_packs(histogram, size)))
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("part", F.col("length").cast("int").alias("length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        offsets = scratch.table(offsets, "offsets", keep=True)
    few = offsets.count() <= broadcast_rows
    ranked = pieces.join(F.broadcast(offsets) if few else offsets.hint("merge"), ["part", "length"]).withColumn("rank", F.col("number") + F.col("before"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    fields = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in columns)
    return ranked.select(*columns, "rank").mapInArrow(_place(table, columns), f"{fields}, sequence_id long, offset long")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 4096 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, with_ids=False)
