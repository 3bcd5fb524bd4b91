"""Segmentation against plain Python on generated units and texts."""

import random

from pyspark.sql import functions as F

from loomfold.functions import scans, text
from loomfold.operators import documents, folds, measures, sampling, segments

KINDS = ("paragraph", "list", "heading", "code")


def merge(units, least):
    """Group sizes by the rules, one unit after the other."""
    out, i = [], 0
    while i < len(units):
        kind, tokens, colon = units[i]
        after = units[i + 1] if i + 1 < len(units) else None
        short = lambda u: u is not None and u[0] == "paragraph" and u[1] < least
        if kind == "paragraph" and colon and after and after[0] == "list" or kind == "heading" and tokens < 8 and short(after):
            out.append(2)
            i += 2
            continue
        n, total = 1, tokens
        while short(units[i]) and i + n < len(units) and short(units[i + n]) and total < least:
            total += units[i + n][1]
            n += 1
        out.append(n)
        i += n
    return out


def absorb(groups, least):
    """Groups as lists of (translate, tokens) after the second pass, by their sizes."""
    out, i = [], 0
    while i < len(groups):
        g = groups[i]
        if not (len(g) == 1 and g[0][0] and g[0][1] < least):
            out.append(g)
            i += 1
        elif out and out[-1][-1][0]:
            out[-1] = out[-1] + g
            i += 1
        elif i + 1 < len(groups) and groups[i + 1][0][0]:
            out.append(g + groups[i + 1])
            i += 2
        else:
            out.append(g)
            i += 1
    return [len(g) for g in out]


def sizes(labels):
    out = []
    for k, x in enumerate(labels):
        if k and labels[k - 1] == x:
            out[-1] += 1
        else:
            out.append(1)
    return out


def test_dependent_units_merge_by_the_rules(spark):
    rng = random.Random(2)
    cases = [[(rng.choice(KINDS), rng.choice([2, 5, 9, 30]), rng.random() < 0.4) for _ in range(rng.randint(1, 12))] for _ in range(150)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, u array<struct<kind:string,tokens:int,colon:boolean>>")
    for r in df.select("k", folds.short_runs(F.col("u"), 10).alias("g")).collect():
        assert sizes(r["g"]) == merge(cases[r["k"]], 10), cases[r["k"]]


def test_orphans_join_a_neighbour(spark):
    rng = random.Random(3)
    cases = [[[(rng.random() < 0.7, rng.choice([3, 20])) for _ in range(rng.choice([1, 1, 2]))] for _ in range(rng.randint(1, 9))] for _ in range(150)]
    rows = [(k, [(len(g), g[0][1], g[0][0], g[0][0], g[-1][0]) for g in c]) for k, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, g array<struct<units:int,tokens:int,translate:boolean,first:boolean,last:boolean>>")
    for r in df.select("k", folds.absorb_orphans(F.col("g"), 10).alias("x")).collect():
        case, want = cases[r["k"]], []
        for group, at in zip(case, r["x"], strict=True):
            if at == len(want):
                want.append(0)
            want[at] += len(group)
        assert want == absorb(case, 10), case


def texts():
    rng = random.Random(4)
    piece = lambda: rng.choice(["# Head", "- one\n- two words here\n  - nested\n- three", "A list follows:", "Short.", "One sentence with 3.5 items. Another one! And a third? " * rng.randint(1, 4), "```\ncode here\n```", "Wait, no.", "> a quote", "`x. y` stays. End."])
    return ["\n\n".join(piece() for _ in range(rng.randint(1, 9))) + rng.choice(["", "\n", "\n\n  "]) for _ in range(60)] + ["", "  \n "]


def test_merged_split_and_grouped_units_make_the_text(spark):
    whole = texts()
    docs = segments.block_arrays(spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string"))
    rows = docs.select("doc_id", "u", segments.merge_units(F.col("u"), F.col("whole"), 10).alias("m"), segments.split_units(F.col("u"), 12).alias("s"), segments.group_steps(F.col("u"), F.col("whole"), most=30, least=5).alias("g")).collect()
    for r in rows:
        t = whole[int(r["doc_id"])]
        for units in (r["u"], r["m"], r["s"], r["g"]):
            assert [u["index"] for u in units] == list(range(len(units)))
            assert all(u["text"] == t[u["char_start"] : u["char_end"]] for u in units)
            assert all(a["char_end"] <= b["char_start"] for a, b in zip(units, units[1:], strict=False))
            bare = lambda us: "".join("".join(u["text"].split()) for u in us)
            assert bare(units) == "".join(t.split())
        for u in r["s"]:  # what is still too large can't be cut
            one_sentence = len([x for x in u["text"].replace("!", ".").replace("?", ".").split(". ") if x]) <= 1
            one_item = sum(line.startswith("- ") for line in u["text"].split("\n")) <= 1
            assert u["tokens"] <= 12 or u["kind"] in ("code", "quote", "heading") or one_sentence or u["kind"] == "list" and one_item
        runs = [u["translate"] for u in r["g"]]
        assert all(k != "code" for u in r["g"] if u["merged_from"] for k in u["merged_from"]) and len(runs) == len(r["g"])
    held = segments.regrouped(docs, most=30, least=5).select("holds.*").collect()
    assert all(h["ordered"] and h["whole"] for h in held)


def test_no_sentence_is_cut_inside_a_kept_span(spark):
    t = "See `a. B` and $x. Y$ here. Then [l](http://a.b/c. d) or 3.5. Done."
    got = spark.createDataFrame([(t,)], "t string").select(segments.safe_sentences(F.col("t")).alias("s")).first()["s"]
    assert "".join(t[x["start"] : x["end"]] for x in got) == t
    assert [t[x["start"] : x["end"]].strip() for x in got][0] == "See `a. B` and $x. Y$ here."


def test_long_arrays_and_texts_take_no_square(spark):
    words = "word and more " * 20_000
    lines = "a line of text\n" * 30_000
    df = spark.createDataFrame([(1, words, lines)], "doc_id long, text string, body string")
    from loomfold.functions import rewards

    row = df.select(rewards.ngram_deficit(F.col("text")).alias("d"), F.size(text.line_starts(F.col("body"))).alias("n")).first()
    assert row["d"] > 0.99 and row["n"] == 30_001
    assert documents.steps(documents.line_arrays(df.select("doc_id", F.col("body").alias("text"))), most=600).count() > 50


def test_scans(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([],), (None,)], "a array<int>")
    got = [r["t"] for r in df.select(scans.running_total(F.col("a")).alias("t")).collect()]
    assert got == [[3, 4, 6], [], None]
    runs = df.select(scans.runs_of(F.col("a"), F.transform("a", lambda x: x > 1)).alias("r")).collect()
    assert [r["r"] for r in runs] == [[[3], [1], [2]], [], None]
    p = spark.createDataFrame([([1.0, 4.0, 2.0],)], "a array<double>").select(scans.percentile_of(F.col("a"), 25.0).alias("p")).first()["p"]
    assert p == 1.5


def test_line_ends_of_python(spark):
    for t in ("a\r\nb\rc\n", "x\x0by z", "", "\n\n", "one"):
        want, at = [], 0
        for line in t.splitlines(keepends=True):
            want.append(at)
            at += len(line)
        assert spark.createDataFrame([(t,)], "t string").select(text.line_starts(F.col("t"), every_end=True).alias("s")).first()["s"] == want, repr(t)


def test_ranks_and_quantiles_without_one_task(spark):
    rng = random.Random(6)
    values = [rng.randint(0, 40) for _ in range(700)] + [7] * 900
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    rows, n = sampling.ranked(df, "v", ranges=7)
    got = sorted((r["rank"], r["v"]) for r in rows.collect())
    assert n == 1600 and [k for k, _ in got] == list(range(1, 1601)) and [v for _, v in got] == sorted(values)
    q = measures.index_quantiles(df, "v", {"p10": (1, 10), "p50": (1, 2), "p99": (99, 100)}).first()
    s = sorted(values)
    assert (q["n"], q["p10"], q["p50"], q["p99"]) == (1600, s[160], s[800], s[1584])
    empty = measures.index_quantiles(df.limit(0), "v", {"p": (1, 2)}).first()
    assert empty["n"] == 0 and empty["p"] is None
    assert sampling.ranked(df.limit(0), "v")[0].count() == 0
