import random

import numpy as np

from loomfold.llm.mixing import DOMAINS, KEEP, fit_rates, mix_documents

KIND = "doc_id long, text string, n_tokens long, rate double, id long"


def corpus(n=900):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        kind = rng.choices(DOMAINS, (8, 2, 1))[0]
        words = [rng.choice(["the", "of", "and", "more", "less", "some"]) for _ in range(40)]
        extra = {"good": [], "poor": ["zz%%", "yy&&", "xx!!"], "toxic": ["awful", "bad"]}[kind]
        docs.append((i, " ".join(words + extra * 2), 1, 2.0, 3))
        if i % 2:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    return docs, labels


def test_expected_totals_meet_their_targets(spark):
    docs, labels = corpus()
    out = mix_documents(spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs) and all(r["rate"] >= 0 and r["copies"] >= 0 for r in out)
    for i, d in enumerate(DOMAINS):
        before = sum(r["n_tokens"] * r["posterior"][i] for r in out)
        after = sum(r["n_tokens"] * r["posterior"][i] * r["rate"] for r in out)
        assert abs(after - KEEP[d] * before) <= 0.0011 * max(1.0, KEEP[d] * before), (d, before, after)
    good = [r for r in out if r["posterior"][0] > 0.9]
    assert len(good) > 500 and sum(r["copies"] == 1 for r in good) >= 0.97 * len(good)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 1), (8, None, None), (7, 0, None)], "doc_id long, quality int, toxic int")
    assert len(mix_documents(odd_docs, labels).collect()) == len(odd_rows)
    out = mix_documents(odd_docs, labels.limit(0)).collect()
    assert len(out) == len(odd_rows) and {r["n_tokens"] for r in out if not (r["rest"]["text"] or "").strip()} == {0}
    assert mix_documents(no_docs, labels).count() == 0


def test_totals_meet_targets_with_few_very_long_documents(spark):
    rng = random.Random(6)
    rows, totals = [], [0.0, 0.0, 0.0]
    for i in range(3000):
        n = 20_000 if i % 500 == 0 else int(20_000 ** (rng.random() * 0.7))
        own = rng.choices(range(3), (15, 4, 1))[0]
        rows.append(tuple(n * (0.999 if d == own else 0.0005) for d in range(3)))
        totals = [a + b for a, b in zip(totals, rows[-1], strict=True)]
    targets = [t * KEEP[d] for t, d in zip(totals, DOMAINS, strict=True)]
    steps, miss = fit_rates(spark.createDataFrame(rows, "l0 double, l1 double, l2 double"), targets)
    assert len(steps) <= 20
    rates = dense_rates(np.array(rows), steps)
    assert (rates >= 0).all()
    got = np.array(rows).T @ rates
    for g, t, m in zip(got, targets, miss, strict=True):
        assert abs(g - t) <= 1e-3 * t and abs((g - t) - m) <= 1e-6 * t


def dense_rates(loads, steps):
    """The steps on a matrix of loads."""
    rates = np.ones(len(loads))
    for w in steps:
        rates = np.maximum(0, rates - loads @ np.array(w))
    return rates


def slow_rates(loads, targets, rounds=200_000):
    """Plain projected gradient with a safe step, until nothing moves."""
    scaled, rates = loads / targets, np.ones(len(loads))
    length = 1 / np.linalg.eigvalsh(scaled.T @ scaled)[-1]
    for _ in range(rounds):
        miss = scaled.T @ rates - 1
        if np.abs(miss).max() < 1e-4:
            break
        rates = np.maximum(0, rates - length * scaled @ miss)
    return rates, np.abs(miss).max()


def test_the_slow_solver_meets_what_the_fast_one_meets(spark):
    rng = np.random.default_rng(2)
    for keep in ([1.0, 0.5, 0.3], [2.0, 0.2, 1.5]):
        loads = rng.dirichlet([2, 1, 0.5], 120) * rng.integers(1, 40, (120, 1))
        targets = loads.sum(0) * keep
        steps, miss = fit_rates(spark.createDataFrame([tuple(map(float, r)) for r in loads], "l0 double, l1 double, l2 double"), list(map(float, targets)))
        slow, least = slow_rates(loads, targets)
        met = np.abs(np.array(miss) / targets).max()
        assert np.allclose(loads.T @ dense_rates(loads, steps) - targets, miss, atol=1e-6)
        assert (met <= 1e-3) == (least <= 1e-3) and (slow >= 0).all()


def test_targets_out_of_reach_give_the_least_misfit(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i), 1, 2.0, 3) for i in range(20)], KIND)
    out = mix_documents(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    # all posteriors are thirds, so the three totals are the same and the least squares are at the targets' mean
    third = sum(r["n_tokens"] for r in out) / 3
    after = sum(r["n_tokens"] * r["rate"] for r in out) / 3
    assert abs(after - third * sum(KEEP.values()) / 3) <= 0.02 * third
    assert len({r["misfit"] for r in out}) == 1 and out[0]["misfit"] > 0.9


def test_clean_documents_stay_where_no_rates_meet_the_targets(spark):
    docs, _ = corpus(200)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    out = mix_documents(spark.createDataFrame(docs, KIND), labels).collect()
    assert out[0]["misfit"] > 1e-3 and sum(r["copies"] == 1 for r in out) >= 190


def test_text_is_worked_out_again_to_the_same_rates(spark):
    docs, labels = corpus(300)
    d, known = spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    key = lambda df: sorted((r["rest"]["doc_id"], round(r["rate"], 9), r["copies"]) for r in df.collect())
    assert key(mix_documents(d, known)) == key(mix_documents(d, known, carry=["doc_id"]))
