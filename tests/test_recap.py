from pyspark.sql import functions as F

from loomfold.functions import tokens
from loomfold.operators import documents
from loomfold.plans import catalogue

EARLY = "\n".join(f"alpha beta gamma w{n} w{n + 1}" for n in range(40))
TEXTS = [EARLY + "\n\nalpha beta new1\nIn conclusion all else\nnew2 new3 w7\n...", "one", "", None, " \n\n", "a b\na b\nc\na", EARLY]


def by_definition(text):
    import re

    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r")]
    counts = [len(x.split()) for x in lines]
    words = [set(re.findall("[a-z0-9']+", x.lower())) for x in lines]
    late = [sum(counts[:i]) / max(sum(counts), 1) >= 0.85 for i in range(len(lines))]
    early = set().union(*[w for w, x in zip(words, late, strict=True) if not x])
    return [x and (line.lower().strip().startswith(("in conclusion", "in summary")) or bool(w) and len(w & early) >= 0.5 * len(w)) for line, w, x in zip(lines, words, late, strict=True)]


def test_recaps_from_arrays_and_from_rows(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    wanted = {(d, i): r for d, t in enumerate(TEXTS) for i, r in enumerate(by_definition(t))}
    assert any(wanted.values())
    for units in (documents.line_arrays(docs), documents.line_units(docs)):
        assert {(r["doc_id"], r["index"]): r["is_recap"] for r in documents.with_recap(units).collect()} == wanted


def test_recaps_need_no_exchange(spark):
    """Windows and joins over units with their texts held more in a task the larger the table was."""
    plan = catalogue.QUERIES["recap_units"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Sort", "Join"))


def test_masks_are_shared_by_the_places_of_a_block(spark):
    rows = [[1, 1, 0, 1, 1, 1, 0], [], None, [0, 0], [1], [1, None, 1, 1, 1]]
    df = spark.createDataFrame([(x,) for x in rows], "a array<int>")
    for block in (1, 2, 4, 9):
        own = df.select(tokens.sampling_mask(F.col("a"), block).alias("m"))
        for x, (m,) in zip(rows, own.collect(), strict=True):
            assert m == (x and [[a == 1 and b == 1 and k // block <= q // block for k, b in enumerate(x)] for q, a in enumerate(x)] if x else x)
        plan = own._jdf.queryExecution().optimizedPlan().toString()
        assert "slice" in plan and "<=" not in plan  # no test for each pair of places
