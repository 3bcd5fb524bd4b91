"""Documents as ordered units, and units as steps: window functions for neighbours, folds for resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import bind, percentile_of
from ..functions.text import chunked, cosine, has_marker, piece_of, placeholder_set, prior_context, starts_with_closing, starts_with_marker, token_count, word_set
from .blocks import restore
from .folds import step_breaks


def unit_id(doc_id: Column, index: Column) -> Column:
    return F.format_string("%s:%04d", doc_id.cast("string"), index)


def line_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A unit for each non-blank line, numbered in order: doc_id, index, text, tokens. Blank documents give none."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\r\n]"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(lines).alias("index", "text")).withColumn("tokens", token_count(F.col("text")))


def within(order: str = "index") -> Window:
    return Window.partitionBy("doc_id").orderBy(order)


def with_context(units: DataFrame, most: int = 100) -> DataFrame:
    """The end of the previous unit's text."""
    return units.withColumn("context", prior_context(F.lag("text").over(within()), most))


def with_gaps(units: DataFrame, texts: DataFrame) -> DataFrame:
    """The text between a unit and the next, or the end (units have index, char_start and char_end, texts doc_id and text).

    Offsets are gathered by document and meet each text once, in one row; only the gaps go back to the units.
    """
    own = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "char_start", "char_end"))).alias("u"))

    def cut(chunks: Column) -> Column:
        stop = lambda i: F.coalesce(F.get("u", i + 1)["char_start"], F.length("text"))
        return F.transform("u", lambda u, i: F.struct(u["index"].alias("index"), piece_of(chunks, u["char_end"], stop(i)).alias("gap")))

    gaps = own.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", F.inline(bind(chunked(F.col("text")), cut)))
    return units.join(gaps, ["doc_id", "index"])


def with_share(units: DataFrame) -> DataFrame:
    """The share of the document's tokens before each unit."""
    w = Window.partitionBy("doc_id")
    before = F.sum("tokens").over(within().rowsBetween(Window.unboundedPreceding, -1))
    return units.withColumn("share", F.coalesce(before, F.lit(0)) / F.greatest(F.sum("tokens").over(w), F.lit(1)))


def recap_flags(units: Column, least_share: float = 0.85, overlap: float = 0.5) -> Column:
    """Per unit of a document's array, whether it is near the end and opens with a closing phrase or mostly repeats words from before ``least_share``.

    Late units are the last ones of the array, so the early words are those of one stretch of it; a late unit meets only
    those that any late unit has too.
    """

    def judged(us: Column) -> Column:
        total = F.greatest(F.aggregate(us, F.lit(0).cast("long"), lambda n, u: n + u["tokens"]), F.lit(1))
        none = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).alias("n"))
        return bind(total, lambda t: bind(F.aggregate(us, none, lambda a, u: F.struct((a["before"] + u["tokens"]).alias("before"), (a["n"] + (a["before"] / t < least_share).cast("int")).alias("n")), lambda a: a["n"]), lambda n: flagged(us, n)))

    def flagged(us: Column, n: Column) -> Column:
        early = word_set(F.array_join(F.transform(F.slice(us, 1, n), lambda u: u["text"]), "\n"))
        late = F.transform(F.slice(us, n + 1, F.size(us)), lambda u: F.struct(word_set(u["text"]).alias("words"), starts_with_closing(u["text"]).alias("closing")))

        def met(own: Column) -> Column:
            common = F.array_intersect(F.array_distinct(F.flatten(F.transform(own, lambda x: x["words"]))), early)
            return bind(common, lambda c: F.transform(own, lambda x: x["closing"] | ((F.size(x["words"]) > 0) & (F.size(F.array_intersect(x["words"], c)) >= overlap * F.size(x["words"])))))

        return F.concat(F.array_repeat(F.lit(False), n), bind(late, met))

    return bind(units, judged)


def with_recap(units: DataFrame, least_share: float = 0.85, overlap: float = 0.5) -> DataFrame:
    """Units with ``is_recap``, see :func:`recap_flags`.

    ``units`` has a row for each document with the array ``u`` (see :func:`line_arrays`), in which it all happens without an
    exchange; or a row for each unit, which are gathered first.
    """
    if "u" not in units.columns:
        units = nest(units, "doc_id", "index", "u")
    flagged = F.zip_with("u", recap_flags(F.col("u"), least_share, overlap), lambda u, r: u.withField("is_recap", r))
    return units.select("doc_id", F.inline(flagged))


def absorb_between(units: DataFrame, kind: str = "code") -> DataFrame:
    """Translatable units between two of a kind become of that kind."""
    both = (F.lag("kind").over(within()) == kind) & (F.lead("kind").over(within()) == kind)
    return units.withColumn("kind", F.when(F.coalesce(both & F.col("translate"), F.lit(False)), kind).otherwise(F.col("kind"))).withColumn("translate", F.col("translate") & (F.col("kind") != kind))


def neighbour_similarity(rows: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """``similarity`` of each row's vector with the one before in its group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("before", F.lag(vector).over(w)).withColumn("similarity", F.when(F.col("before").isNotNull(), cosine(F.col("before"), F.col(vector)))).drop("before")


def weak_links(rows: DataFrame, group: str, percent: float = 20.0) -> DataFrame:
    """``threshold``: the exact, interpolated percentile of similarities in the group; ``weak`` at or below it."""
    cut = F.percentile("similarity", F.lit(percent / 100)).over(Window.partitionBy(group))
    return rows.withColumn("threshold", cut).withColumn("weak", F.coalesce(F.col("similarity") <= F.col("threshold"), F.lit(False)))


def runs(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``run``: numbers of maximal runs of equal values."""
    w = Window.partitionBy(group).orderBy(order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    return rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w) - 1).drop("changed")


def line_array(text: Column) -> Column:
    """The units of :func:`line_units` as an array."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\r\n]"))
    return F.transform(lines, lambda x, i: F.struct(i.alias("index"), x.alias("text"), token_count(x).alias("tokens")))


def line_arrays(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``u``, the line units of each document in the row they came from."""
    return docs.select(F.col(doc_id).alias("doc_id"), line_array(F.col(text)).alias("u"))


def step_arrays(units: Column, has: set[str], most: int = 600, least: int = 80, percent: float = 20.0, fewest: int = 4, markers: bool = True) -> Column:
    """Steps of an array of units, in the row: step_index, reason, unit_count, token_count, text.

    Units are structs of ``has``: index, tokens, text and maybe ``kind`` and ``similarity`` (with the unit before). The
    semantic rule needs ``fewest`` units.
    """
    none = F.lit(None).cast("double")

    def judged(u: Column) -> Column:
        return F.struct(
            u["tokens"].alias("tokens"),
            ((u["kind"] == "heading") if "kind" in has else F.lit(False)).alias("heading"),
            (starts_with_marker(u["text"]) if markers else F.lit(False)).alias("marker"),
            (u["similarity"] if "similarity" in has else none).alias("similarity"),
        )

    def grouped(u: Column) -> Column:
        cut = F.when(F.size(u) >= fewest, percentile_of(F.filter(F.transform(u, lambda x: x["similarity"]), lambda x: x.isNotNull()), percent)) if "similarity" in has else none
        return bind(step_breaks(F.transform(u, judged), most, least, cut), lambda why: pieces_of(u, why))

    def pieces_of(u: Column, why: Column) -> Column:
        starts = F.filter(F.transform(why, lambda w, i: F.when(w.isNotNull(), F.struct(i.alias("at"), w.alias("why")))), lambda s: s.isNotNull())
        return bind(starts, lambda s: F.transform(s, lambda x, k: bind(F.slice(u, x["at"] + 1, F.coalesce(F.get(s, k + 1)["at"], F.size(u)) - x["at"]), lambda part: F.struct(
            k.alias("step_index"), x["why"].alias("reason"), F.size(part).cast("long").alias("unit_count"),
            F.aggregate(part, F.lit(0).cast("long"), lambda n, y: n + y["tokens"]).alias("token_count"),
            F.array_join(F.transform(part, lambda y: y["text"]), "\n\n").alias("text"),
        ))))

    return bind(units, grouped)


def steps(units: DataFrame, **rule) -> DataFrame:
    """Steps of each document: doc_id, step_index, reason, unit_count, token_count, text.

    ``units`` has a row for each document with the array ``u`` (see :func:`line_arrays`), from which steps come without an
    exchange; or a row for each unit, which are gathered first.
    """
    if "u" not in units.columns:
        kept = [c for c in ("index", "tokens", "text", "kind", "similarity") if c in units.columns]
        units = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("u"))
    has = set(units.schema["u"].dataType.elementType.fieldNames())
    return units.select("doc_id", F.inline(step_arrays(F.col("u"), has, **rule)))


def document_stats(units: DataFrame) -> DataFrame:
    """Per document: units by kind, shares of split and merged ones, tokens to translate."""
    by_kind = units.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("split_index").isNotNull().cast("int")).alias("split"), F.sum(F.col("merged_from").isNotNull().cast("int")).alias("merged"), F.sum(F.when(F.col("translate"), F.col("tokens")).otherwise(0)).alias("tokens"))
    return by_kind.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kind_counts"), (F.sum("split") / F.sum("n")).alias("split_rate"), (F.sum("merged") / F.sum("n")).alias("merge_rate"), F.sum("tokens").alias("translatable_tokens"))


def marker_flags(units: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """``has_markers`` for units of the sources that talk to themselves."""
    return units.withColumn("has_markers", F.col("source").isin(*sources) & has_marker(F.col("text")))


def nest(rows: DataFrame, key: str, order: str, name: str = "items") -> DataFrame:
    """One row for each key with its rows as an ordered array."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias(name))


def reconstruct(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Each document's text with units replaced by their translations where there are any; units have gap."""
    own = units.join(translations.select("unit_id", "hi"), "unit_id", "left")
    piece = F.struct("index", F.concat(F.coalesce("hi", "text"), F.coalesce("gap", F.lit(""))).alias("piece"))
    return own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"]), "").alias("text"))


def checked_pieces(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Units with ``piece``, their text or their translation with its protected spans put back, and ``fault``.

    Units have doc_id, index, text, protected and spans (see :func:`~loomfold.operators.blocks.protected`), translations doc_id, index
    and ``hi``. The placeholders of a translation are held against those of the unit's spans before anything is put
    back: ``fault`` has those that are lost and those that are new, and is null where the sets agree. A unit without a
    translation keeps its text.
    """
    own = units.join(translations.select("doc_id", "index", "hi"), ["doc_id", "index"], "left")
    known = F.array_sort(F.transform("spans", lambda s: s["placeholder"]))

    def judged(found: Column) -> Column:
        fault = F.struct(F.array_except(known, found).alias("lost"), F.array_except(found, known).alias("new"))
        return F.when(F.col("hi").isNotNull() & (found != known), fault)

    own = own.withColumn("fault", bind(placeholder_set(F.col("hi")), judged))
    return own.withColumn("piece", F.when(F.col("hi").isNull(), F.col("text")).when(F.col("fault").isNull(), restore(F.col("hi"), F.col("spans"))))


def reconstruct_checked(units: DataFrame, translations: DataFrame) -> DataFrame:
    """A row for each document: ``text``, or null and the ``failures`` (index, lost, new) of its units.

    One pass gives both outputs; :func:`~loomfold.sources.sinks.write_outcomes` writes them apart. Units have ``gap`` besides, the
    text after them.
    """
    one = F.struct("index", F.concat("piece", F.coalesce("gap", F.lit(""))).alias("piece"), "fault")
    gathered = checked_pieces(units, translations).groupBy("doc_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["index"] < b["index"], -1).when(a["index"] > b["index"], 1).otherwise(0)).alias("u"))
    failures = F.transform(F.filter("u", lambda u: u["fault"].isNotNull()), lambda u: F.struct(u["index"].alias("index"), u["fault"]["lost"].alias("lost"), u["fault"]["new"].alias("new")))
    made = gathered.select("doc_id", "u", failures.alias("failures"))
    return made.select("doc_id", F.when(F.size("failures") == 0, F.array_join(F.transform("u", lambda u: u["piece"]), "")).alias("text"), "failures")
