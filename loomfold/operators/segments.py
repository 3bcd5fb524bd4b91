"""Units of a document as one array: dependent neighbours merged, oversized units split, units grouped into steps.

A unit is a struct of index, kind, translate, char_start, char_end, text, tokens, merged_from and, for a list as it was found, the
offsets of its items. All of it happens in the row, as expressions over the array; nothing is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import bind, percentile_of, runs_of, scan
from ..functions.text import NUMBER, chunked, ends_with_colon, match_spans, piece_of, sentence_spans, starts_with_marker, token_count
from .blocks import scanned
from .folds import absorb_orphans, budget_groups, joined_bounds, short_runs, step_breaks

UNIT = "struct<index:int,kind:string,translate:boolean,char_start:int,char_end:int,text:string,tokens:int,merged_from:array<string>,items:array<struct<start:int,end:int>>>"
#: Spans that a sentence boundary may not cut: code, mathematics, link targets, numbers.
KEPT_WHOLE = r"(?s)`[^`]+`|\$[^$\n]+\$|\\\(.+?\\\)|(?<=\]\()[^)\s]+(?=\))|" + NUMBER.replace("(?U)", "", 1)
ITEMS = "array<struct<start:int,end:int>>"


def unit(index: Column, kind: Column, translate: Column, start: Column, end: Column, text: Column, merged: Column | None = None, items: Column | None = None) -> Column:
    none = F.lit(None).cast("array<string>")
    return F.struct(
        index.cast("int").alias("index"), kind.alias("kind"), translate.alias("translate"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"),
        text.alias("text"), token_count(text).alias("tokens"), (none if merged is None else merged).alias("merged_from"),
        (F.lit(None).cast(ITEMS) if items is None else items).alias("items"),
    )


def block_arrays(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``whole`` and ``u``: the markdown blocks of each document as units; null and blank texts have none."""
    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("whole")).withColumn("b", scanned(F.col("whole")))
    return own.select("doc_id", "whole", numbered(F.transform("b", lambda b: unit(F.lit(0), b["kind"], b["translate"], b["start"], b["end"], b["text"], items=b["items"]))).alias("u"))


def numbered(units: Column) -> Column:
    """Units with their places as index."""
    return F.transform(units, lambda u, i: u.withField("index", i.cast("int")))


def _merged(group: Column, chunks: Column) -> Column:
    """One unit of consecutive ones, from the text (in chunks) between their ends; a single one as it is."""
    first, last = F.get(group, F.lit(0)), F.get(group, F.size(group) - 1)
    text = piece_of(chunks, first["char_start"], last["char_end"])
    return F.when(F.size(group) == 1, first).otherwise(unit(first["index"], first["kind"], F.lit(True), first["char_start"], last["char_end"], text, F.transform(group, lambda u: u["kind"])))


def merge_units(units: Column, whole: Column, least: int) -> Column:
    """Dependent siblings as one unit - a lead-in and its list, a short heading and its short paragraph, short paragraphs in a row - and then lone short units with a neighbour."""
    judged = lambda us: F.transform(us, lambda u: F.struct(u["kind"].alias("kind"), u["tokens"].alias("tokens"), ends_with_colon(u["text"]).alias("colon")))

    def described(g: Column) -> Column:
        first, last = F.get(g, F.lit(0)), F.get(g, F.size(g) - 1)
        return F.struct(F.size(g).alias("units"), first["tokens"].alias("tokens"), first["translate"].alias("translate"), first["translate"].alias("first"), last["translate"].alias("last"))

    def absorbed(groups: Column) -> Column:
        return runs_of(groups, absorb_orphans(F.transform(groups, described), least))

    pairs = bind(bind(units, lambda us: runs_of(us, short_runs(judged(us), least))), absorbed)
    return numbered(bind(chunked(whole), lambda c: F.transform(pairs, lambda gs: bind(F.flatten(gs), lambda g: _merged(g, c)))))


def _cut(u: Column, spans: Column) -> Column:
    """A unit's parts at (start, end) offsets of its text; the unit itself for one."""
    part = lambda c: lambda s, i: unit(i, u["kind"], F.lit(True), u["char_start"] + s["start"], u["char_start"] + s["end"], piece_of(c, s["start"], s["end"]), u["merged_from"])
    return bind(spans, lambda s: F.when(F.size(s) <= 1, F.array(u)).otherwise(bind(chunked(u["text"]), lambda c: F.transform(s, part(c)))))


def within_budget(text: Column, spans: Column, most: int) -> Column:
    """Consecutive (start, end) spans joined while their tokens stay within the budget; one that is larger alone stays whole."""

    def joined(s: Column) -> Column:
        counts = bind(chunked(text), lambda c: F.transform(s, lambda x: token_count(piece_of(c, x["start"], x["end"]))))
        return F.transform(runs_of(s, budget_groups(counts, most)), lambda g: F.struct(F.get(g, F.lit(0))["start"].alias("start"), F.get(g, F.size(g) - 1)["end"].alias("end")))

    return bind(spans, joined)


def safe_sentences(text: Column) -> Column:
    """Sentences without boundaries inside spans that are kept whole; they cover the text."""

    def joined(s: Column) -> Column:
        bounds = F.transform(s, lambda x: x["start"])
        kept = F.array_distinct(F.concat(F.slice(bounds, 1, 1), joined_bounds(bounds, match_spans(text, KEPT_WHOLE))))
        return bind(kept, lambda k: F.transform(k, lambda b, i: F.struct(b.alias("start"), F.coalesce(F.get(k, i + 1), F.length(text)).alias("end"))))

    return bind(sentence_spans(text), joined)


def split_units(units: Column, most: int) -> Column:
    """Oversized units to translate in parts: lists at items (but not those merged with a lead-in), paragraphs at sentences; tables and others stay."""

    def parts(u: Column) -> Column:
        big = u["translate"] & (u["tokens"] > most)
        lists = big & (u["kind"] == "list") & u["items"].isNotNull()
        return (
            F.when(lists, bind(u["items"], lambda s: F.when(F.size(s) <= 1, F.array(u)).otherwise(_cut(u, within_budget(u["text"], s, most)))))
            .when(big & (u["kind"] == "paragraph"), _cut(u, within_budget(u["text"], safe_sentences(u["text"]), most)))
            .otherwise(F.array(u))
        )

    return numbered(F.flatten(F.transform(units, parts)))


def split_rate(before: Column, after: Column) -> Column:
    """The share of units that were split, given the unit arrays before and after (by the starts that are new)."""
    starts = lambda a: F.transform(a, lambda u: u["char_start"])

    def share(us: Column) -> Column:
        hit = bind(F.array_except(starts(after), starts(us)), lambda new: F.filter(us, lambda u: F.exists(new, lambda n: (u["char_start"] < n) & (n < u["char_end"]))))
        return F.when(F.size(us) == 0, 0.0).otherwise(F.size(hit) / F.size(us))

    return bind(before, share)


def group_steps(units: Column, whole: Column, most: int = 600, least: int = 80, percent: float = 20.0, fewest: int = 4, similarities: Column | None = None, markers: bool = True) -> Column:
    """Units as whole steps: the boundary rule within each run of units to translate, with a threshold of the run's own; others stay alone.

    ``similarities`` has each unit's similarity with the unit before.
    """
    if similarities is None:
        rows = F.transform(units, lambda u: F.struct(u.alias("u"), F.lit(None).cast("double").alias("s")))
    else:
        rows = F.zip_with(units, similarities, lambda u, s: F.struct(u.alias("u"), s.alias("s")))
    alone = lambda r: scan(F.transform(r, lambda x: x["u"]), F.struct(F.lit(0).alias("n"), F.lit(False).alias("t")), lambda a, u: F.struct((a["n"] + F.when(u["translate"] & a["t"], 0).otherwise(1)).alias("n"), u["translate"].alias("t")), lambda before, u, after: after["n"], "int")

    def grouped(run: Column, chunks: Column) -> Column:
        inner = F.slice(run, 2, F.greatest(F.size(run) - 1, F.lit(0)))
        cut = F.when(F.size(run) >= fewest, percentile_of(F.filter(F.transform(inner, lambda r: r["s"]), lambda x: x.isNotNull()), percent))
        marker = (lambda u: starts_with_marker(u["text"])) if markers else (lambda u: F.lit(False))
        judged = F.transform(run, lambda r: F.struct(r["u"]["tokens"].alias("tokens"), (r["u"]["kind"] == "heading").alias("heading"), marker(r["u"]).alias("marker"), r["s"].alias("similarity")))
        number = lambda why: scan(why, F.struct(F.lit(0).alias("n")), lambda a, w: F.struct((a["n"] + w.isNotNull().cast("int")).alias("n")), lambda before, w, after: after["n"], "int")
        return F.transform(runs_of(run, number(step_breaks(judged, most, least, cut))), lambda g: _merged(F.transform(g, lambda r: r["u"]), chunks))

    return numbered(bind(chunked(whole), lambda chunks: F.flatten(F.transform(bind(rows, lambda r: runs_of(r, alone(r))), lambda run: bind(run, lambda r: grouped(r, chunks))))))


def gaps_of(units: Column, whole: Column) -> Column:
    """The text after each unit up to the next; the last has none."""
    return bind(chunked(whole), lambda c: bind(units, lambda us: F.transform(us, lambda u, i: F.coalesce(F.when(i + 1 < F.size(us), piece_of(c, u["char_end"], F.get(us, i + 1)["char_start"])), F.lit("")))))


def invariants(units: Column, whole: Column) -> Column:
    """``ordered``: units don't overlap and none is negative; ``whole``: units and gaps make the text, whose first unit begins at 0."""
    def judged(us: Column) -> Column:
        placed = F.transform(us, lambda u, i: (u["char_start"] <= u["char_end"]) & (u["char_start"] >= F.coalesce(F.get(us, i - 1)["char_end"], F.lit(0))))
        made = F.array_join(F.zip_with(us, gaps_of(us, whole), lambda u, g: F.concat(u["text"], g)), "")
        return F.struct(F.forall(placed, lambda x: x).alias("ordered"), ((F.size(us) == 0) | (made == whole)).alias("whole"))

    return bind(units, judged)


def regrouped(docs: DataFrame, **rule) -> DataFrame:
    """Documents of :func:`block_arrays` (or with ``u`` from a later step) with their units as steps, gaps, counts and invariants."""
    own = docs.withColumn("u", group_steps(F.col("u"), F.col("whole"), **rule))
    return own.select("doc_id", "u", gaps_of(F.col("u"), F.col("whole")).alias("gaps"), F.length("whole").alias("original_length"), F.aggregate("u", F.lit(0).cast("long"), lambda n, u: n + F.when(u["translate"], u["tokens"]).otherwise(0)).alias("translatable_tokens"), invariants(F.col("u"), F.col("whole")).alias("holds"))
