import hashlib

from loomfold.llm.linededup import LineRuns, dedup_lines

BLANK = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = ascii_lower(line.strip(BLANK))
            if len(k) >= 10:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(ascii_lower(x.strip(BLANK)), i) >= i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_against_brute_force_for_any_number_of_batches(spark):
    rows = [(i, "\n".join([f"a common line {i % 3}", " A COMMON LINE 0\t", f"own line number {i}", "short", f"é{'ß' * (i % 12)}x"])) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 4, 9):
        got = sorted((r["rest"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"] or "") for r in dedup_lines(docs, batches=batches, fanout=2).collect())
        assert got == brute(rows)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = dedup_lines(odd_docs).collect()
    assert len(got) == len(odd_rows)
    by = {r["rest"]["doc_id"]: r for r in got}
    assert by[0]["kept_text"] is None and by[0]["n_lines"] == 1
    assert by[6]["n_dropped"] == 1 and by[6]["kept_text"] == "other"
    assert by[90]["n_dropped"] == 2 and by[90]["kept_text"] == "\nshort"
    assert sum(r["n_dropped"] for r in got if r["rest"]["doc_id"] == 5) == 0  # repeats of one document
    assert by[5]["rest"]["shard"] == 2
    assert dedup_lines(no_docs).count() == 0


def test_runs_are_compacted(spark):
    runs = LineRuns(spark, fanout=2)
    for b in range(4):
        runs.add(spark.createDataFrame([(k, 0, b) for k in range(b * 5, b * 5 + 8)], "h1 long, h2 long, holder long"))
    runs._compact()
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    held = {r["h1"]: r["holder"] for r in spark.table(runs.tables()[0]).collect()}
    assert held == {k: min(3, k // 5) if k % 5 >= 3 or k < 5 else max(0, k // 5 - 1) for k in range(23)}
    runs.close()
    assert not spark.catalog.listTables() or not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_with_a_home_take_up_the_next_batch(spark, tmp_path):
    home = str(tmp_path / "runs")
    rows = [(i, f"a line that comes again {i % 4}\nown line number {i}") for i in range(24)]
    got = []
    for k in range(0, 24, 8):  # each time as a new application would find them
        runs = LineRuns(spark, fanout=2, home=home)
        out = dedup_lines(spark.createDataFrame(rows[k : k + 8], "doc_id long, text string"), batches=1, runs=runs)
        got += [(r["rest"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()]
        runs.close()
    assert sorted(got) == brute(rows)


def test_common_lines_and_rows_without_ids(spark):
    common = "the line that every document has"
    rows = [(i if i < 1500 else None, f"{common}\nown line number {i % 1600}") for i in range(1700)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=2).collect()
    kept = [r for r in got if r["n_dropped"] == 0]
    assert [r["rest"]["doc_id"] for r in kept] == [0] and len(got) == 1700
    # rows without an id are one document after all others, so their own lines stay however often they come
    assert all(r["kept_text"].startswith("own line") == (r["rest"]["doc_id"] is not None or int(r["kept_text"][16:] or -1) >= 1500) for r in got if r["n_dropped"] == 1)


def test_hash_of_kept_text(spark):
    from pyspark.sql import functions as F

    out = dedup_lines(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).select(F.sha2("kept_text", 256).alias("h")).first()
    assert out["h"] == hashlib.sha256(b"abc").hexdigest()
