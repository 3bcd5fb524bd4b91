import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from loomfold.llm.importance import blocks_of_words, op13_resampling, resample, ring_buckets, word_table


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features_of(text, longest, buckets):
    w = words_of(text)
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1))


def by_hand(rows, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    own = [(i, words_of(t), features_of(t, longest, buckets)) for i, t in rows]
    s, t = sum((f for *_, f in own), Counter()), sum((features_of(x, longest, buckets) for x in target), Counter())
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)}
    out = []
    for i, w, f in own:
        n = sum(f.values())
        weight = sum(gain[b] * c for b, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_ring_emits_the_crc_of_every_run(longest):
    rng = random.Random(longest)
    for _ in range(30):
        words = ["".join(rng.choice("abé9") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 25))]
        ring, got, at = [], [], 0
        while at < len(words):  # the ring goes on from block to block
            n = rng.randint(1, 6)
            found, ring = ring_buckets([w.encode() for w in words[at : at + n]], ring, longest, 977)
            got, at = got + found, at + n
        assert Counter(got) == features_of(" ".join(words), longest, 977)


def test_blocks_cut_no_word():
    rng, table = random.Random(4), word_table()
    for block in (1, 2, 7, 50):
        for _ in range(60):
            t = "".join(rng.choice("aZ9éß中 \n_.-\x7f\xa0") for _ in range(rng.randint(0, 120)))
            assert [w.decode() for b in blocks_of_words(t.encode(), table, block) for w in b] == words_of(t)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (3, 35), (1, 100), (2, 0)])
def test_draws_are_those_of_a_plain_count(spark, longest, percent):
    rng = random.Random(longest)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 10 + i % 50]) for _ in range(rng.choice([0, 5, 19, 20, 21, 60])))) for i in range(300)]
    target = [" ".join(rng.choice(vocabulary[40:]) for _ in range(30)) for _ in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    done = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, longest=longest, buckets=500)
    assert rows_of(done) == by_hand(rows, target, percent, longest=longest, buckets=500)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows]
    target = spark.createDataFrame([("one two word",), (None,), ("",)], "text string")
    assert rows_of(resample(odd_docs, target, percent=60, least_words=1)) == by_hand(rows, ["one two word", None, ""], 60, 1)
    assert rows_of(resample(odd_docs, target.limit(0), percent=60, least_words=1)) == by_hand(rows, [], 60, 1)
    assert resample(no_docs, target).count() == 0


def test_equal_scores_go_to_smaller_ids_and_long_texts_are_read_whole(spark):
    long = "alpha beta " * 300_000 + "omega"
    rows = [(5, long), (5, long), (None, "a b c"), (None, "a b c"), (None, "x y z"), (2, "a b c")]
    done = resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("omega a",)], "text string"), percent=50, least_words=3)
    assert rows_of(done) == by_hand(rows, ["omega a"], 50, 3)


def test_the_query_is_the_plain_count_of_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert rows_of(op13_resampling(spark, folder)) == by_hand(rows, target)
