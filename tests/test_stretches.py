"""Blocks and spans of a batch of texts are made for a stretch of texts at a time."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfold.operators import blocks

TEXT = "# Head 12\n\nSee `a` and $x$ at 3.5% of [b](https://h/1).\n\n- one\n- two 2\n  - three\n\n> quote\n\n```\ncode 7\n```\n"


def test_stretches_hold_few_characters_and_every_text():
    texts = pa.array(["ab", None, "", "c" * 50, "def", "g" * 9, "", "hi"])
    out = list(blocks.stretches(texts, 10))
    assert [t for _, own in out for t in own] == [t or "" for t in texts.to_pylist()]
    assert [n for n, _ in out] == [0, 3, 4, 5, 7] and all(len(own) == 1 or sum(map(len, own)) <= 10 for _, own in out)
    assert list(blocks.stretches(pa.array([], pa.string()))) == []


def test_lengths_of_batches_may_differ(spark, monkeypatch):
    """More texts than one stretch holds, of which some are null, blank or larger than a stretch."""
    big = TEXT * 400
    monkeypatch.setattr(blocks.stretches, "__defaults__", (30_000,))
    docs = spark.createDataFrame([(n, [TEXT * (n % 7 * 8), None, " \n", "", big][n % 5]) for n in range(60)], "doc_id long, text string").repartition(2).cache()
    got = {r["doc_id"]: r for r in docs.select("doc_id", "text", blocks.scanned(F.col("text")).alias("b"), blocks.protected(F.col("text")).alias("p")).collect()}
    assert len(got) == 60
    units = {}
    for r in blocks.block_units(docs).collect():
        units.setdefault(int(r["doc_id"]), []).append((r["index"], r["kind"], r["translate"], r["char_start"], r["char_end"], r["text"]))
    for n, r in got.items():
        t = r["text"] or ""
        top = blocks.top_blocks(t)
        assert [(b["kind"], b["translate"], b["start"], b["end"], b["text"]) for b in r["b"]] == [(k, k not in blocks.UNTOUCHED, a, z, t[a:z]) for k, a, z, _ in top]
        assert [b["items"] and [tuple(i) for i in b["items"]] for b in r["b"]] == [items if k == "list" else None for k, _, _, items in top]
        assert (r["p"]["protected"], [tuple(s) for s in r["p"]["spans"]]) == blocks.protect(t)
        assert sorted(units.get(n, [])) == [(i, *x) for i, x in enumerate((b["kind"], b["translate"], b["start"], b["end"], b["text"]) for b in r["b"])]


@pytest.mark.parametrize("f", [blocks.scanned, blocks.protected])
def test_little_is_held_of_a_large_batch(f):
    batch = pa.array([TEXT * 20] * 800)
    tracemalloc.start()
    n = sum(len(x) for x in f.func(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 800 and most < 16 << 20
