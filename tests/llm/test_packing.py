import random
import zlib

import numpy as np
import pytest

from loomfold.llm.packing import WordIds, default_tokenizer, pack_documents, place_table, plan_packs, resolve_tokenizer


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all_and_leaves_little_room(seed):
    rng = random.Random(seed)
    size = 512
    histogram = {}
    for _ in range(4000):
        n = min(size, max(1, int(rng.expovariate(1 / 120)))) if seed else 100
        histogram[n] = histogram.get(n, 0) + 1
    packs = plan_packs(histogram, size)
    placed = {}
    for count, pattern in packs:
        assert sum(n * k for n, k in pattern) <= size
        for n, k in pattern:
            placed[n] = placed.get(n, 0) + count * k
    assert placed == histogram
    total, used = sum(n * c for n, c in histogram.items()), sum(c for c, _ in packs)
    assert used <= total / size * (1.03 if seed else 1.05) + 1


def one_by_one(lengths, size):
    """Shortest-pack-first a piece at a time: free spaces of the packs when all are placed."""
    spaces, todo = [], sum(lengths)
    waiting = sorted(lengths, reverse=True)
    while waiting:
        n = waiting[0]
        best = max(range(len(spaces)), key=spaces.__getitem__, default=None)
        if best is not None and spaces[best] >= n:
            spaces[best] -= n
            todo -= n
            waiting.pop(0)
            continue
        opened = min(waiting.count(n), max(1, -(-(todo - sum(spaces)) // size)))
        for _ in range(opened):
            spaces.append(size - n)
            todo -= n
            waiting.pop(0)
    return sorted(spaces)


@pytest.mark.parametrize("seed", range(8))
def test_counts_of_patterns_place_as_one_by_one(seed):
    rng = random.Random(seed)
    lengths = [min(64, max(1, int(rng.expovariate(1 / 20)))) for _ in range(300)] + [64] * 5
    histogram = {n: lengths.count(n) for n in set(lengths)}
    packs = plan_packs(histogram, 64)
    assert sorted(64 - sum(n * k for n, k in p) for c, p in packs for _ in range(c)) == one_by_one(lengths, 64)
    rows = place_table(packs)
    for n, c in histogram.items():  # each rank of each length has just one range
        own = rows[rows[:, 0] == n]
        assert own[0, 1] == 0 and all(own[i, 1] < own[i + 1, 1] for i in range(len(own) - 1)) and own[-1, 1] < c


def test_special_strings_and_names():
    from tokenizers import Tokenizer

    plain, ids = Tokenizer.from_file(resolve_tokenizer("word_bpe_49k.json")), WordIds(default_tokenizer())
    for t in ("a <|endoftext|> b", "<|startoftext|>", "A<|endoftext|>B <|ENDOFTEXT|>", "x < | y"):
        assert ids.of(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert resolve_tokenizer("/no/such/folder/word_bpe_49k.json") == default_tokenizer()


def test_offsets_joined_by_an_exchange_give_the_same_packs(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 90)) for i in range(400)], "doc_id long, text string").repartition(5, "doc_id")
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"]) for r in df.collect())
    few, many = pack_documents(docs, size=64, with_ids=False), pack_documents(docs, size=64, with_ids=False, broadcast_rows=0)
    assert key(few) == key(many)
    for df in (few, many):
        by = df.groupBy("sequence_id").agg({"length": "sum", "offset": "count"}).collect()
        assert max(r["sum(length)"] for r in by) <= 64
        starts = sorted((r["sequence_id"], r["offset"], r["length"]) for r in df.collect())
        assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(starts, starts[1:], strict=False))


def test_long_text_is_cut_into_pieces(spark):
    text = "one two three, four " * 40_000
    got = pack_documents(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string"), with_ids=False).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == next(r["doc_tokens"] for r in got if r["doc_id"] == 1) == 200_001
    assert [r["length"] for r in got if r["doc_id"] == 3] == [1]


def test_plan_of_nothing():
    assert plan_packs({}, 8) == []


def test_words_give_the_ids_of_the_whole_text():
    ids = WordIds(default_tokenizer())
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAbB .,!'s\td\n é İ Σς 12٣½ ﬁ ß 中 🙂 \r\x1c\xa0 'll don't <|endoftext|> -_ ") for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    for t, got in zip(texts, ids.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.of(t) == np.array(got.ids, "<u4").tobytes(), t


def test_capitals_with_marks_give_the_ids_of_the_whole_text():
    import unicodedata

    ids, rng = WordIds(default_tokenizer()), random.Random(8)
    marks = [chr(i) for i in (*range(0x300, 0x370), 0x5B0, 0x64E, 0x93C, 0x94D, 0x1DC0, 0x20D0, 0x3099, 0x1161, 0x11A8) if unicodedata.combining(chr(i)) or i > 0x1000]
    letters = ["Y", "y", "\u0130", "I", "\u017f", "\u0399", "\u03a3", "\u1f88", "H", "T", "W", "A", "J", "\u212a", "\u1100", "\u0958", "\u0915", " ", "\n", "'S", "1", "."]
    texts = ["Y\u030a", "\u0130\u093c", "A J\u030c"] + ["".join(rng.choice(letters if rng.random() < 0.55 else marks) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0x3000), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    wrong = [t for t, got in zip(texts, ids.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if ids.of(t) != np.array(got.ids, "<u4").tobytes()]
    assert not wrong, wrong[:5]


def test_pieces_make_the_documents(spark, odd_docs, odd_rows, no_docs):
    got = pack_documents(odd_docs, default_tokenizer(), size=64).collect()
    ids = WordIds(default_tokenizer())
    want = sorted((i, ids.of(t or "") + (2).to_bytes(4, "little")) for i, t, *_ in odd_rows if i is not None)
    pieces = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["length"] <= 64
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, data in dict(want).items():
        own = sorted(pieces[i], key=lambda r: r["start"])
        times = sum(1 for j, _ in want if j == i)
        assert sum(r["length"] for r in own) == times * len(data) // 4
        assert {bytes(r["ids"]) for r in own} == {data[4 * s : 4 * (s + 64)] for s in range(0, len(data) // 4, 64)}
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert pack_documents(no_docs, default_tokenizer()).count() == 0
