import corpus_pipeline
from loomfold.llm.shared import materialize


def test_stages_keep_clean_documents_and_drop_copies(spark, tmp_path):
    import random

    rng = random.Random(2)
    parts = {"en": "the and ing tion er".split(), "fr": "eau que oux ent les".split()}
    rows = []
    for i in range(80):
        lang = rng.choice(list(parts))
        rows.append((i, "\n".join(" ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(12)) for _ in range(4)), lang, "s", 0))
    rows += [(100, rows[3][1], "en", "s", 0), (101, "123 456", None, None, None), (102, None, None, None, None), (103, rows[4][1].replace("\n", " ") + " end", "en", "s", 0), (104, rows[5][1].rsplit(" ", 1)[0] + " other", "fr", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert set(range(80)) <= left[0] and not {101, 102} & left[0]
    assert 100 not in left[1]
    assert set(range(80)) <= left[2] and 103 not in left[2]
    assert len(left[3] & set(range(80))) >= 78 and left[4] == left[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(left[3])


def test_empty_input(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unlearned_texts_are_rejected(spark):
    import random

    rng = random.Random(7)
    parts = {"en": "the and ing tion er".split(), "fr": "eau que oux ent les".split()}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(40)), lang, "s", 0) for i, lang in enumerate(["en", "fr"] * 60)]
    letters = lambda own: " ".join("".join(rng.choices(own, k=7)) for _ in range(40))
    rows += [(200 + i, letters(own), None, "s", 0) for i, own in enumerate(["абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπρ", "語文字書本日人大小中", "abcdefghijklmnopqrstuvwxyz"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert left == set(range(120))


def test_each_stage_does_its_own_work_on_its_own_input(spark, tmp_path):
    """Stage by stage against plain Python: lines, near copies, targets and tokens."""
    import random

    from loomfold.llm.mixing import DOMAINS, KEEP, mix_documents
    from loomfold.llm.packing import WordIds, default_tokenizer

    from .conftest import near_copies
    from .test_linededup import brute as lines_of
    from .test_ngramjoin import brute as components_of

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("the and ing tion er".split(), k=2))
    # poor and toxic texts have words of their own, so the labels can be told from the text and the targets met
    odd = {1: "zzpoor", 2: "qqtoxic"}
    texts = near_copies(3, 4, 5) + ["\n".join([f"common line of all {i % 2}", *(" ".join([*(word() for _ in range(9)), *[odd[d] + word()[:2] for d in (i % 5,) if d in odd]]) for _ in range(4))]) for i in range(160)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    sort = ["poor" if "zzpoor" in t else "toxic" if "qqtoxic" in t else "good" for t in texts]
    labels = spark.createDataFrame([(i, int(s != "poor"), int(s == "toxic")) for i, s in enumerate(sort) if i % 3], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, kind)
    got = materialize(corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)), "a")
    want = {i: t for i, _, dropped, t in lines_of([(r[0], r[1]) for r in rows]) if not dropped or t.strip(" ")}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in got.collect())
    one = materialize(corpus_pipeline.keep_one_of_each(spark, got, str(tmp_path)), "b")
    component = components_of(sorted(want.items()), 5, 80)
    assert {r["doc_id"] for r in one.collect()} == {i for i, c in component.items() if i == c}
    mixed = mix_documents(one, labels).collect()
    for d, name in enumerate(DOMAINS):
        before = sum(r["n_tokens"] * r["posterior"][d] for r in mixed)
        after = sum(r["n_tokens"] * r["posterior"][d] * r["rate"] for r in mixed)
        assert before > 0 and abs(after - KEEP[name] * before) <= 1.001e-3 * KEEP[name] * before, name
    copies = sorted(i for r in mixed for i in [r["rest"]["doc_id"]] * r["copies"])
    chosen = materialize(corpus_pipeline.mix_to_targets(spark, one, str(tmp_path)), "c")
    assert sorted(r["doc_id"] for r in chosen.collect()) == copies
    ids = WordIds(default_tokenizer())
    packed = corpus_pipeline.pack(spark, chosen, str(tmp_path)).collect()
    assert sum(r["length"] for r in packed) == sum(len(ids.of(r["text"])) // 4 + 1 for r in chosen.collect())
    assert {r["doc_id"] for r in packed} == set(copies)
