"""Personal data by weak supervision, with DataFrame operations only.

Candidates come from patterns; offsets are code points, found by folding over the pieces between matches. Five labelers
vote on each candidate (for, against, or nothing): the shape, a gazetteer, words before it, its edges, and its variety.
Expectation-maximisation over the counts of vote patterns (at most kinds * 3 ** 5 rows, whatever the corpus) estimates how
far each labeler can be trusted and gives every pattern a probability. A naive Bayes classifier of span features, trained
on those soft labels over all candidates, decides about the kinds that no fixed rule covers. Spans that a fixed rule
finds (email, ip, card, phone) always stay.

Patterns are written so that the Java engine neither backtracks nor recurses: possessive loops, and a start only where a
run of the class begins or the previous match ended.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import scan
from .shared import Scratch

#: Kinds in their order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "local_phone")
BASE = 4
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+",
    "local_phone": r"(?<![0-9+(-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_SHAPE = rf"\A(?:{OCTET.replace('*+', '*')})(?:\.(?:{OCTET.replace('*+', '*')})){{3}}\z"
#: Endings of hosts: generic ones and any two letters, as countries have them.
ENDINGS = r"\A(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|mobi|dev|app|online|site|[a-z]{2})\z"
#: Country codes of E.164, zone by zone; two digits where they are a code, else three.
COUNTRIES = r"\A(?:1|7|2(?:0|7|[1-689][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[789][0-9])|8(?:[1246]|[035789][0-9])|9(?:[0-58]|[679][0-9]))"
ISSUERS = r"\A(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
KEY_HEADS = r"\A(?:AKIA|ASIA|ghp_|gho_|sk_|pk_|xox[abp]-)"
CUES = {
    "email": r"(?i)(?:mail|contact|write|@|kontakt|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse)",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta|payment)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|anruf)",
    "secret": r"(?i)(?:token|key|secret|pass(?:word|wd)?|pwd|auth)[\"'\x20]*[:=]?[\"'\x20]*\z",
    "local_phone": r"(?i)(?:phone|tel|call|mobile|fax|anruf)",
}
LABELERS = ("shape", "gazetteer", "cue", "edges", "variety")
SPAN = "struct<start:int,ord:int,end:int,kind:string,hit:string,before:string,after:string>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    doubled = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_holds(kind: Column, hit: Column) -> Column:
    """The fixed rule of the base kinds beyond their pattern; false for the others."""
    n = F.length(_digits(hit))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", hit.rlike(IP_SHAPE))
        .when(kind == "card", F.when(n.between(14, 19), luhn(_digits(hit))).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(False)
    )


def candidates(text: Column, docs: DataFrame) -> DataFrame:
    """``docs`` with ``found``: all matches of all patterns, leftmost and not overlapping within a kind."""
    df = docs.withColumn("body", F.coalesce(text.cast("string"), F.lit("")))
    digit = F.col("body").rlike("[0-9]")
    guard = {"email": F.contains("body", F.lit("@")), "phone": F.contains("body", F.lit("+"))}
    none = F.array().cast("array<string>")
    cuts = {}
    for k in KINDS:
        use = guard.get(k, digit)
        cuts[f"m_{k}"] = F.when(use, F.regexp_extract_all("body", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none)
    df = df.withColumns(cuts)
    # a second pass over the text only where something was found
    df = df.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split("body", PATTERNS[k], -1)).otherwise(none) for k in KINDS})

    def placed(k: str) -> Column:
        hits = F.arrays_zip(f"m_{k}", f"p_{k}", F.slice(f"p_{k}", F.lit(2), F.greatest(F.size(f"p_{k}") - 1, F.lit(0))).alias(f"q_{k}"))
        after = lambda a, x: F.struct((a["at"] + F.length(x[f"p_{k}"]) + F.length(x[f"m_{k}"])).alias("at"))

        def span(before: Column, x: Column, end: Column) -> Column:
            start = before["at"] + F.length(x[f"p_{k}"])
            return F.struct(
                start.alias("start"), F.lit(KINDS.index(k)).alias("ord"), end["at"].alias("end"), F.lit(k).alias("kind"), x[f"m_{k}"].alias("hit"),
                F.right(x[f"p_{k}"], F.lit(24)).alias("before"), F.left(x[f"q_{k}"], F.lit(24)).alias("after"),
            )

        return scan(F.filter(hits, lambda x: x[f"m_{k}"].isNotNull()), F.struct(F.lit(0).alias("at")), after, span, SPAN)

    return df.withColumn("found", F.concat(*[placed(k) for k in KINDS]))


def votes(x: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1, -1 or 0."""
    kind, hit, n = x["kind"], x["hit"], F.length(_digits(x["hit"]))
    yes = lambda c, otherwise=0: F.when(c, 1).otherwise(otherwise)
    shape = (
        F.when(kind == "secret", yes(hit.rlike(r"\A(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{16,})\z")))
        .when(kind == "local_phone", yes(n == 10, -1))
        .otherwise(yes(base_holds(kind, hit), -1))
    )
    gazetteer = (
        F.when(kind == "email", yes(F.lower(F.substring_index(hit, ".", -1)).rlike(ENDINGS), -1))
        .when(kind == "ip", yes(~hit.rlike(r"\A(?:0|127|255)\."), -1))
        .when(kind == "card", yes(_digits(hit).rlike(ISSUERS), -1))
        .when(kind == "phone", yes(_digits(hit).rlike(COUNTRIES), -1))
        .when(kind == "secret", yes(hit.rlike(KEY_HEADS)))
        .otherwise(0)
    )
    cue = F
    for k in KINDS:
        cue = cue.when(kind == k, yes(x["before"].rlike(CUES[k])))
    edges = yes(x["before"].rlike(r"[\p{L}0-9_]\z") | x["after"].rlike(r"\A[\p{L}0-9_]"), 0) * -2 + 1
    variety = yes(F.size(F.array_distinct(F.regexp_extract_all(hit, F.lit(r"[A-Za-z0-9]"), F.lit(0)))) >= 5, -1)
    return dict(zip(LABELERS, (shape, gazetteer, cue, edges, variety), strict=True))


def features(x: Column) -> Column:
    """Names of what the classifier sees of a span; a few hundred different ones at most."""
    hit, kind = x["hit"], x["kind"]
    share = F.floor(4 * F.length(_digits(hit)) / F.greatest(F.length(hit), F.lit(1))).cast("string")
    edge = lambda c, at: F.when(c.rlike(rf"{at('[0-9]')}"), "0").when(c.rlike(at(r"\p{L}")), "a").when(c.rlike(at(r"\s")), "_").when(c.rlike(at(r"[=:\"']")), "=").otherwise(".")
    return F.array(
        F.concat(kind, F.lit("/length/"), F.least(F.floor(F.log2(F.length(hit))), F.lit(7)).cast("string")),
        F.concat(kind, F.lit("/digits/"), share),
        F.concat(kind, F.lit("/left/"), edge(x["before"], lambda c: rf"{c}\z")),
        F.concat(kind, F.lit("/right/"), edge(x["after"], lambda c: rf"\A{c}")),
        F.concat(kind, F.lit("/word/"), F.pmod(F.crc32(F.lower(F.regexp_extract(x["before"], r"(\p{L}+)[^\p{L}]*\z", 1)).cast("binary")), F.lit(32)).cast("string")),
        F.concat(kind, F.lit("/case/"), F.when(hit.rlike("[a-z]"), "l").otherwise(""), F.when(hit.rlike("[A-Z]"), "u").otherwise("")),
    )


def reliabilities(counts: dict[tuple, int], rounds: int = 40) -> tuple[dict[tuple, float], dict[str, dict[bool, dict[int, float]]]]:
    """EM over vote patterns. ``counts`` maps (kind, *votes) to rows; gives each pattern's probability, and P(vote | class) of each labeler.

    Starts from the mean vote. One pseudo-count keeps every probability away from 0 and 1.
    """
    belief = {p: 1 / (1 + math.exp(-sum(p[1:]))) for p in counts}
    trust: dict[str, dict[bool, dict[int, float]]] = {}
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        trust = {name: {y: dict.fromkeys((-1, 0, 1), 1.0) for y in (False, True)} for name in LABELERS}
        for p, n in counts.items():
            both = prior.setdefault(p[0], [1.0, 1.0])
            for y, share in ((True, belief[p]), (False, 1 - belief[p])):
                both[y] += n * share
                for name, v in zip(LABELERS, p[1:], strict=True):
                    trust[name][y][v] += n * share
        for t in trust.values():
            for y in t:
                total = sum(t[y].values())
                t[y] = {v: c / total for v, c in t[y].items()}
        for p in counts:
            odds = math.log(prior[p[0]][1] / prior[p[0]][0])
            odds += sum(math.log(trust[name][True][v] / trust[name][False][v]) for name, v in zip(LABELERS, p[1:], strict=True))
            belief[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return belief, trust


def _lookup(values: dict[str, float]) -> Column:
    if not values:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.lit(float(v)) for v in values.values()]))


def find_pii(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``rest`` (a struct of the carried columns, all but the text by default) and ``spans``, an array of start, ord, end, kind, hit, base and score.

    Spans are sorted by start, then kind. An added span that overlaps a base one is left out; added spans may overlap each
    other. Null texts are empty and have none, as have empty ones; texts of any length are read whole, in time that grows
    with their length; repeated rows are judged each; an empty table gives no rows; what other columns hold or are called
    doesn't matter.
    """
    names = [c for c in docs.columns if c != text] if carry is None else carry
    rest = F.struct(*[docs[c] for c in names]) if names else F.struct(F.lit(None).cast("string").alias("nothing"))
    found = candidates(F.col("text_in"), docs.select(rest.alias("rest"), docs[text].alias("text_in"))).select("rest", "found")
    key = lambda x: F.concat_ws("/", x["kind"], *[v.cast("string") for v in votes(x).values()])
    judged = found.select(
        "rest",
        F.transform("found", lambda x: F.struct(x["start"], x["ord"], x["end"], x["kind"], x["hit"], base_holds(x["kind"], x["hit"]).alias("base"), key(x).alias("votes"), features(x).alias("features"))).alias("found"),
    )
    # candidates only, no texts; the result reads them
    judged = Scratch(docs.sparkSession).table(judged, "pii", keep=True)
    each = judged.select(F.explode("found").alias("x"))
    rows = each.groupBy("x.votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most len(KINDS) * 3 ** 5 rows
    counts = {(r["votes"].split("/")[0], *map(int, r["votes"].split("/")[1:])): r["n"] for r in rows}
    belief, _ = reliabilities(counts) if counts else ({}, {})
    soft = _lookup({"/".join(map(str, p)): b for p, b in belief.items()})
    p = F.coalesce(F.element_at(F.col("soft"), F.col("x.votes")), F.lit(0.5))
    by_name = each.select("x", soft.alias("soft")).select(F.col("x.kind").alias("kind"), F.explode("x.features").alias("name"), p.alias("p")).groupBy("kind", "name").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # a few hundred rows
    totals: dict[str, list[float]] = {}
    per_span = 6
    for r in by_name:
        both = totals.setdefault(r["kind"], [1.0, 1.0])
        both[0] += r["yes"] / per_span
        both[1] += r["no"] / per_span
    weights = {r["name"]: math.log((r["yes"] + 0.5) / (totals[r["kind"]][0] + 1)) - math.log((r["no"] + 0.5) / (totals[r["kind"]][1] + 1)) for r in by_name}
    start = _lookup({k: math.log(a / b) for k, (a, b) in totals.items()})
    scored = judged.select("rest", "found", _lookup(weights).alias("w"), start.alias("s")).select(
        "rest",
        F.transform(
            "found",
            lambda x: F.struct(x["start"], x["ord"], x["end"], x["kind"], x["hit"], x["base"], F.aggregate(x["features"], F.coalesce(F.element_at(F.col("s"), x["kind"]), F.lit(0.0)), lambda a, f: a + F.coalesce(F.element_at(F.col("w"), f), F.lit(0.0))).alias("score")),
        ).alias("found"),
    )
    split = scored.select("rest", F.filter("found", lambda x: x["base"]).alias("sure"), F.filter("found", lambda x: (x["ord"] >= BASE) & (x["score"] > 0)).alias("more"))
    added = F.filter("more", lambda x: ~F.exists("sure", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return split.select("rest", F.array_sort(F.concat("sure", added)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_weak_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    base = F.filter("spans", lambda x: x["base"])
    number = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return out.select(F.col("rest.doc_id").alias("doc_id"), *[number(k) for k in KINDS[:BASE]], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


