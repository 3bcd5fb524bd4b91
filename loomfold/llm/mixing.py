"""Soft-membership mixing to target weights, with DataFrame operations only.

1. A labelled table names the domain of some documents. Words whose presence tells domains apart are picked from a bounded
   sample of labelled rows; a naive Bayes classifier of those words' presence gives every document a posterior over domains.
2. Let t be a document's tokens, p its posterior and r its rate (expected copies). Projected gradient finds rates r >= 0 with
   the least squares of ``sum(r * t * p)`` less the targets: each step moves every rate along its own load t * p, weighted by
   the misfits of the domains, and sets what falls below 0 to 0. A step is a weight for each domain, so a rate is replayed from
   its row's load and the few steps so far; none is ever stored or exchanged. A round needs one aggregate of about as many
   numbers as there are domains squared, and partitions may be lost and read again at any time.
3. Rates become whole copies: the integer part, and one more when a hash of the id falls below the rest.
"""

from __future__ import annotations

import json
import logging
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

log = logging.getLogger(__name__)

#: Domains by their labels, and the share of its present tokens that each is to have.
DOMAINS = ("good", "poor", "toxic")
KEEP = {"good": 1.0, "poor": 0.5, "toxic": 0.05}


def label_domain(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled row; null without a label."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def all_words(text: Column) -> Column:
    """Words of the whole text in lower case; the first and the last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")


def count_tokens(words: Column) -> Column:
    """How many of :func:`all_words` aren't empty."""
    edge = lambda i: (F.element_at(words, i) == "").cast("int")
    return F.when(F.size(words) == 1, 1 - edge(1)).otherwise(F.size(words) - edge(1) - edge(-1)).cast("long")


def fit_domains(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, words: int = 256, least_odds: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> dict[str, list[float]]:
    """Log-odds of each picked word's presence and, under "", of each domain for a document with none of them.

    Learns from at most about ``sample_rows`` labelled rows, lowest hash of the id first; that bound is all that learning
    sees. The words are those that speak most for some domain - its share of rows with the word times the log-odds - among
    the ones with log-odds of at least ``least_odds`` there and in at least five sampled rows.
    """
    known = labels.select(F.col("doc_id").alias("l_id"), label_domain(F.col("quality"), F.col("toxic")).alias("domain")).where("domain is not null").groupBy("l_id").agg(F.max("domain").alias("domain"))
    total = known.count()
    share = min(1.0, sample_rows / max(1, total))
    picked = known.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = docs.select(F.col(doc_id).alias("l_id"), F.array_distinct(all_words(F.col(text))).alias("words")).join(F.broadcast(picked) if sample_rows <= 100_000 else picked, "l_id")
    by_domain = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each domain
    sizes = {d: 0 for d in DOMAINS} | {r["domain"]: r["n"] for r in by_domain}
    cells = rows.select("domain", F.explode("words").alias("word")).where("word <> ''").groupBy("word").pivot("domain", list(DOMAINS)).agg(F.count(F.lit(1)))
    odds, absent = [], []
    for d in DOMAINS:
        other = sum(sizes.values()) - sizes[d]
        inside, outside = F.coalesce(F.col(d), F.lit(0)), reduce(lambda a, b: a + b, [F.coalesce(F.col(x), F.lit(0)) for x in DOMAINS if x != d])
        odds.append(F.log((inside + 0.5) / (sizes[d] + 1.0)) - F.log((outside + 0.5) / (other + 1.0)))
        absent.append(F.log((sizes[d] - inside + 0.5) / (sizes[d] + 1.0)) - F.log((other - outside + 0.5) / (other + 1.0)))
    seen = reduce(lambda a, b: a + b, [F.coalesce(F.col(d), F.lit(0)) for d in DOMAINS])
    speaks = F.greatest(*[F.when(o >= least_odds, o * F.coalesce(F.col(d), F.lit(0)) / max(1, sizes[d])).otherwise(0.0) for d, o in zip(DOMAINS, odds, strict=True)])
    best = cells.where(seen >= 5).select("word", F.array(*odds).alias("odds"), F.array(*absent).alias("absent"), speaks.alias("speaks")).where("speaks > 0").orderBy(F.desc("speaks"), "word").limit(words).collect()
    out = {r["word"]: [max(-4.0, min(4.0, x)) for x in r["odds"]] for r in best}
    # words that a document lacks speak as well; they aren't independent, so together they count within limits
    lacking = [max(-6.0, min(6.0, sum(r["absent"][i] for r in best))) for i in range(len(DOMAINS))]
    out[""] = [math.log((sizes[d] + 1.0) / (sum(sizes.values()) + len(DOMAINS))) + x for d, x in zip(DOMAINS, lacking, strict=True)]
    return out


def with_posterior(df: DataFrame, words: str, model: dict[str, list[float]]) -> DataFrame:
    """``df`` with ``posterior``: probabilities of the domains, in order, from the words present."""
    prior = F.array(*[F.lit(float(x)) for x in model[""]])
    known = {w: x for w, x in model.items() if w}
    if not known:
        score = prior
    else:
        # one literal instead of a thousand; the optimizer makes a map of it once
        table = F.from_json(F.lit(json.dumps(known)), "map<string,array<double>>")
        score = F.aggregate(F.array_intersect(words, F.map_keys(table)), prior, lambda a, w: F.zip_with(a, F.element_at(table, w), lambda x, y: x + y))
    s = [F.get("score", F.lit(i)) for i in range(len(DOMAINS))]
    shares = [1 / reduce(lambda a, b: a + b, [F.exp(F.least(F.lit(700.0), other - own)) for other in s]) for own in s]
    return df.withColumn("score", score).withColumn("posterior", F.array(*shares)).drop("score")


def _rate(steps: list[list[float]]) -> Column:
    """1 after all steps: each takes off its weights times the row's loads ``l0, l1, ...``, and what falls below 0 is 0."""
    out = F.lit(1.0)
    for weights in steps:
        pull = reduce(lambda a, b: a + b, [F.col(f"l{i}") * F.lit(float(w)) for i, w in enumerate(weights)])
        out = F.greatest(F.lit(0.0), out - pull)
    return out


def fit_rates(loads: DataFrame, targets: list[float], rounds: int = 200, tolerance: float = 1e-3) -> tuple[list[list[float]], list[float]]:
    """The steps of :func:`_rate`, and each total less its target. ``loads`` has ``l0, l1, ...``: tokens times posterior of each document.

    The misfits are squared in tokens. A step is their gradient scaled by the inverse Gram matrix of the
    documents whose rate is above 0 - those cut off at 0 no longer answer, and would make it far too short - and halved until
    the squares fall by a tenth. Where that fails, as it does if no rates meet the targets, the plain gradient with
    the length that is best for those documents is taken. Ends when every total is within ``tolerance`` of its target or the
    squares no longer fall, or when the rounds, each a scan of the loads or a few, are used up: each round leaves rates that fit better, and the misfits
    say how well.
    """
    dims = range(len(targets))
    squares = lambda miss: sum(m * m for m in miss)

    def judge(steps: list[list[float]]):
        """Misfits at the rates after these steps, and the Gram matrix of the documents with a rate above 0."""
        cells = [F.sum(F.when(F.col("r") > 0, F.col(f"l{i}") * F.col(f"l{j}")).otherwise(0.0)).alias(f"g{i}_{j}") for i in dims for j in dims if i <= j]
        got = loads.withColumn("r", _rate(steps)).agg(*[F.coalesce(F.sum(F.col(f"l{i}") * F.col("r")), F.lit(0.0)).alias(f"t{i}") for i in dims], *cells).first()
        return [got[f"t{i}"] - targets[i] for i in dims], [[got[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in dims] for i in dims]

    steps: list[list[float]] = []
    miss, gram = judge(steps)
    for _ in range(rounds):
        if all(abs(m) <= tolerance * max(1.0, t) for m, t in zip(miss, targets, strict=True)) or not any(gram[i][i] for i in dims):
            return steps, miss
        trace = sum(gram[i][i] for i in dims)
        answer = [sum(gram[i][j] * miss[j] for j in dims) for i in dims]  # how the totals move along the plain gradient
        best = sum(m * a for m, a in zip(miss, answer, strict=True)) / max(1e-300, squares(answer))
        tries = [([length * x for x in _solve(gram, miss, 1e-9 * trace)], 0.9) for length in (1.0, 0.5, 0.25)]
        tries += [([best * length * x for x in miss], 0.999) for length in (1.0, 0.5, 0.25, 0.125, 0.0625)]
        for step, enough in tries:
            then = judge([*steps, step])
            if squares(then[0]) <= enough * squares(miss):
                break
        else:
            return steps, miss
        steps, (miss, gram) = [*steps, step], then
    return steps, miss


def _solve(matrix: list[list[float]], right: list[float], ridge: float) -> list[float]:
    """Gaussian elimination with a ridge, for as many unknowns as domains."""
    n = len(right)
    a = [[*row, right[i]] for i, row in enumerate(matrix)]
    for i in range(n):
        a[i][i] += ridge
    for i in range(n):
        p = max(range(i, n), key=lambda k: abs(a[k][i]))
        a[i], a[p] = a[p], a[i]
        for k in range(n):
            if k != i and a[i][i]:
                f = a[k][i] / a[i][i]
                a[k] = [x - f * y for x, y in zip(a[k], a[i], strict=True)]
    return [a[i][n] / a[i][i] if a[i][i] else 0.0 for i in range(n)]


def mix_documents(docs: DataFrame, labels: DataFrame, keep: dict[str, float] | None = None, carry: list[str] | None = None, text: str = "text", doc_id: str = "doc_id", **fit) -> DataFrame:
    """``rest`` (a struct of the carried columns, all by default), ``n_tokens``, ``posterior``, ``rate``, ``copies`` and ``misfit``.

    ``keep`` is the share of its expected tokens that each domain is to have afterwards, from which the target totals come.
    ``misfit``, the same in every row, is the largest distance of an expected total from its target, as a share of the target;
    it is above 0.001 only where no rates meet the targets or the rounds didn't do, which is logged as well.
    Null and empty texts have no tokens and the prior as posterior, so they keep a rate of 1; null ids and repeated rows are
    documents like others, and rows of one id and rate become as many copies each; texts of any length are read whole;
    without labels all domains are equally likely; an empty table gives no rows; further columns are carried only.

    Posteriors are worked out once and stored with the carried columns in the shared folder until the application ends.
    """
    spark = docs.sparkSession
    keep, carry = keep or KEEP, carry or docs.columns
    model = fit_domains(docs, labels, text=text, doc_id=doc_id, **fit)
    own = docs.select(F.struct(*[docs[c] for c in carry]).alias("rest"), docs[doc_id].alias("id"), docs[text].alias("body"))
    cut = own.select("rest", "id", all_words(F.col("body")).alias("words"))
    judged = with_posterior(cut, "words", model).select("rest", "id", count_tokens(F.col("words")).alias("n_tokens"), "posterior")
    judged = judged.withColumns({f"l{i}": F.get("posterior", F.lit(i)) * F.col("n_tokens") for i in range(len(DOMAINS))})
    names = [f"l{i}" for i in range(len(DOMAINS))]
    with Scratch(spark) as scratch:
        judged = scratch.table(judged, "loads", keep=True)
        loads = judged.select(*names)
        totals = loads.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names]).first()
        targets = [totals[c] * keep[d] for c, d in zip(names, DOMAINS, strict=True)]
        steps, miss = fit_rates(loads, targets)
    misfit = max(abs(m) / max(1.0, t) for m, t in zip(miss, targets, strict=True))
    if misfit > 1e-3:
        log.warning("rates don't meet the targets %s of %s: the totals miss them by %s", targets, DOMAINS, miss)
    rated = judged.withColumn("rate", _rate(steps))
    chance = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return rated.select("rest", "n_tokens", "posterior", "rate", copies.alias("copies"), F.lit(misfit).alias("misfit"))


def op5_soft_mixing(spark, sf_dir: str) -> DataFrame:
    """Rates of all ``documents`` so that the expected tokens of each labelled domain meet their targets."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = mix_documents(docs, labels, carry=["doc_id", "source"])
    shares = [F.round(F.get("posterior", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return out.select("rest.doc_id", "rest.source", "n_tokens", *shares, F.round("rate", 6).alias("rate"), "copies", F.round("misfit", 6).alias("misfit"))
