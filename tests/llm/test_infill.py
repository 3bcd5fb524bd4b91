import hashlib
import random
import re

import pytest

from loomfold.llm.infill import infill, op12_infill, restored


def by_hand(doc_id, text, percent=90, spm=20):
    """(n, form, prefix, middle, suffix, output) from the whole list of tokens."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 2048])
def test_chunks_cut_where_a_whole_scan_does(spark, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("aZ é\n.🙂<S>") for _ in range(rng.randint(0, 40))) for _ in range(250)] + ["a" * 50, "." * 50, "ab" * 30 + "!", "<" * 9, "x<P", "S>"]
    rows = list(enumerate(texts))
    done = infill(spark.createDataFrame(rows, "doc_id long, text string"), size=size)
    got = {r["doc_id"]: r for r in done.withColumn("again", restored(done["output"], done["form"])).collect()}
    for i, t in rows:
        assert tuple(got[i][c] for c in ("n", "form", "prefix", "middle", "suffix", "output")) == by_hand(i, t), t
        assert got[i]["again"] == t
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    done = infill(odd_docs)
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["output"], r["again"]) for r in done.withColumn("again", restored(done["output"], done["form"])).collect())
    want = []
    for i, t, *_ in odd_rows:
        n, form, *_, output = by_hand(i, t)
        want.append((str(i), n, form, output, t or ""))
    assert got == sorted(want)
    assert infill(no_docs).count() == 0


def test_a_long_text_takes_linear_time(spark):
    text = "ab, " * 700_000
    for t in (text, "x" * 2_500_000):
        r = infill(spark.createDataFrame([(7, t)], "doc_id long, text string")).collect()[0]
        assert tuple(r)[1:] == by_hand(7, t)


def test_the_query_restores_every_text(spark):
    rows = op12_infill(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        n, form, p, m, _, output = by_hand(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, None if p is None else len(p), None if m is None else len(m))
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
