import random

import numpy as np
from pyspark.sql import functions as F

from loomfold.llm.langid import KernelModel, fit_languages, held_out, predict_languages, spectrum_of

PARTS = {"aa": "the and ing tion er".split(), "bb": "der und sch ung ein".split(), "cc": "eau que oux ent les".split()}


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        rows.append((i, " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(30)), lang))
    return rows


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(400), "doc_id long, text string, lang string")
    out = predict_languages(docs, fit_languages(docs)).withColumn("held", held_out(F.col("rest.doc_id"))).where("held")
    rows = out.collect()
    assert len(rows) > 50
    assert sum(r["lang_pred"] == r["rest"]["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["lang_score"] <= 1 for r in rows)


def test_labels_of_held_out_rows_are_never_seen(spark):
    docs = spark.createDataFrame(corpus(200), "doc_id long, text string, lang string")
    odd = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert fit_languages(odd).langs == ["aa", "bb", "cc"]


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = predict_languages(odd_docs, fit_languages(odd_docs)).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        letters = any(c.isalpha() for c in r["rest"]["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
    assert predict_languages(no_docs, fit_languages(no_docs)).count() == 0
    assert KernelModel.of_texts([], []).predict(["text", None]) == (["und", "und"], [0.0, 0.0])


def test_decisions_are_those_of_dense_kernel_ridge(spark):
    """Distributed learning against the formulas written out: the same landmarks, whole kernel matrices, no folding."""
    rows = [r for r in corpus(160, 4) if r[0] % 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs, per_language=40, landmarks=30)
    picked = [r.asDict() for r in docs.where(~held_out(F.col("doc_id"))).select("text", "lang", F.xxhash64("doc_id").alias("h")).collect()]
    sample = []
    for lang in sorted(PARTS):
        sample += [(k < 10, lang, r["text"]) for k, r in enumerate(sorted((r for r in picked if r["lang"] == lang), key=lambda r: r["h"])[:40])]
    sets = [set(spectrum_of(t)[0].tolist()) for _, _, t in sample]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = [s for s, r in zip(sets, sample, strict=True) if r[0]]
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(inner)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = np.array([[kernel(a, b) for b in marks] for a in sets]) @ root
    wanted = np.array([[1.0 if lang == x else -1.0 for x in sorted(PARTS)] for _, lang, _ in sample])
    weights = np.linalg.solve(features.T @ features + 1e-4 * len(sample) * np.eye(len(marks)), features.T @ wanted)
    texts = [t for _, t, _ in corpus(60, 9)]
    decisions = np.array([[kernel(set(spectrum_of(t)[0].tolist()), b) for b in marks] for t in texts]) @ root @ weights
    names, scores = model.predict(texts)
    assert names == [sorted(PARTS)[k] for k in decisions.argmax(1)]
    assert np.allclose(scores, np.clip((1 + decisions.max(1)) / 2, 0, 1), atol=2e-3)


def test_long_texts_and_repeated_rows_teach(spark):
    long_texts = [(i, "ooze zzip " * 4000, "zz") for i in range(40)]  # 40,000 characters each
    again = [(1000, corpus(1, 3)[0][1], "rr")] * 500
    docs = spark.createDataFrame(corpus(60) + [(200 + i, t, lang) for i, t, lang in long_texts] + again, "doc_id long, text string, lang string")
    model = fit_languages(docs, per_language=20)
    assert set(model.langs) >= {"aa", "bb", "cc", "zz"}
    assert model.predict(["zzip ooze zzip"])[0] == ["zz"]
