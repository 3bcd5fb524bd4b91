"""Ordered folds whose state starts anew at points that depend on the data, as typed ``aggregate`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scans import bind, scan


def budget_groups(counts: Column, most: int) -> Column:
    """The group number of each piece: a new group begins when the piece would take a non-empty group over ``most``."""
    zero = F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, n: Column) -> Column:
        fresh = (a["g"] < 0) | ((a["sum"] > 0) & (a["sum"] + n > most))
        return F.struct(F.when(fresh, a["g"] + 1).otherwise(a["g"]).alias("g"), F.when(fresh, n.cast("long")).otherwise(a["sum"] + n).alias("sum"))

    return scan(counts, zero, step, lambda before, n, after: after["g"], "int")


def step_breaks(units: Column, most: int, least: int, threshold: Column | None = None) -> Column:
    """Why a step begins at each unit, null where it goes on.

    Units are structs of tokens, heading, marker and similarity (with the unit before). In order: a heading, a marker, a
    full step, a weak link once the step is long enough. The first unit's reason is ``start``.
    """
    zero = F.struct(F.lit(True).alias("first"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("string").alias("why"))

    if threshold is None:
        return _step_breaks(units, most, least, zero, None)
    return bind(threshold, lambda t: _step_breaks(units, most, least, zero, t))


def _step_breaks(units: Column, most: int, least: int, zero: Column, threshold: Column | None) -> Column:
    def step(a: Column, u: Column) -> Column:
        weak = F.lit(False) if threshold is None else F.coalesce((a["sum"] >= least) & (u["similarity"] <= threshold), F.lit(False))
        why = F.when(a["first"], "start").when(u["heading"], "heading").when(u["marker"], "discourse_marker").when(a["sum"] >= most, "token_cap").when(weak, "semantic_break")
        return bind(why, lambda w: F.struct(F.lit(False).alias("first"), F.when(w.isNotNull(), u["tokens"].cast("long")).otherwise(a["sum"] + u["tokens"]).alias("sum"), w.alias("why")))

    return scan(units, zero, step, lambda before, u, after: after["why"], "string")


def short_runs(units: Column, least: int) -> Column:
    """Group numbers that merge dependent neighbours.

    Units are structs of kind, tokens, colon (ends with one). A paragraph that ends with a colon takes the list after it, a
    heading of under 8 tokens the short paragraph after it, and short paragraphs run together until they make ``least``.
    """
    zero = F.struct(F.lit(-1).alias("g"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, u: Column) -> Column:
        short = (u["kind"] == "paragraph") & (u["tokens"] < least)
        run = a["kind"].isin("run", "short colon") & short & (a["sum"] < least)
        joins = (a["g"] >= 0) & ((a["kind"].isin("colon", "short colon") & (u["kind"] == "list")) | ((a["kind"] == "head") & short) | run)
        alone = F.when((u["kind"] == "paragraph") & u["colon"], F.when(short, "short colon").otherwise("colon")).when((u["kind"] == "heading") & (u["tokens"] < 8), "head").when(short, "run").otherwise("done")
        return F.struct(
            F.when(joins, a["g"]).otherwise(a["g"] + 1).alias("g"),
            F.when(joins & run, "run").when(joins, "done").otherwise(alone).alias("kind"),
            F.when(joins, a["sum"] + u["tokens"]).otherwise(u["tokens"].cast("long")).cast("long").alias("sum"),
        )

    return scan(units, zero, step, lambda before, u, after: after["g"], "int")


def absorb_orphans(groups: Column, least: int) -> Column:
    """The group that each group goes to: a lone short unit joins a neighbour.

    Groups are structs of units, tokens, translate (of the only unit), first and last (whether the first and the last unit are
    to be translated). A group of one unit to translate with fewer than ``least`` tokens joins the group before if that one's
    last unit is to be translated, else the group after if that one's first is, and else stays. What joins the group after
    counts as its first unit. A group that was joined to the one before lends it its own last unit.
    """
    zero = F.struct(F.lit(-1).alias("g"), F.lit(False).alias("open"), F.lit(False).alias("lead"))
    zipped = bind(groups, lambda gs: F.transform(gs, lambda g, i: F.struct(g.alias("g"), F.coalesce(F.get(gs, i + 1)["first"], F.lit(False)).alias("n"))))

    def step(a: Column, z: Column) -> Column:
        g = z["g"]
        lone = (g["units"] == 1) & g["translate"] & (g["tokens"] < least) & ~a["lead"]
        back = lone & a["open"]
        ahead = lone & ~a["open"] & z["n"]
        return F.struct(
            F.when(a["lead"] | back, a["g"]).otherwise(a["g"] + 1).alias("g"),
            F.when(ahead, F.lit(False)).otherwise(g["last"]).alias("open"),
            ahead.alias("lead"),
        )

    return scan(zipped, zero, step, lambda before, z, after: after["g"], "int")


def area_batches(sizes: Column, most: int) -> Column:
    """Batch numbers: a new batch when one more row, at the width of the widest, would pass ``most``."""
    zero = F.struct(F.lit(-1).alias("g"), F.lit(0).alias("n"), F.lit(0).alias("wide"))

    def step(a: Column, x: Column) -> Column:
        fresh = (a["g"] < 0) | ((a["n"] + 1) * F.greatest(a["wide"], x) > most)
        return F.struct(F.when(fresh, a["g"] + 1).otherwise(a["g"]).alias("g"), F.when(fresh, 1).otherwise(a["n"] + 1).alias("n"), F.when(fresh, x).otherwise(F.greatest(a["wide"], x)).alias("wide"))

    return scan(sizes.cast("array<int>"), zero, step, lambda before, x, after: after["g"], "int")


def joined_bounds(bounds: Column, spans: Column) -> Column:
    """Ascending boundaries without those strictly inside a span (start, end).

    Boundaries and spans are swept together in order: a boundary is inside one if those that began before it reach beyond it.
    """
    points = F.transform(bounds, lambda b: F.struct(b.cast("int").alias("at"), F.lit(0).alias("spans"), F.lit(0).alias("end")))
    begun = F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("at"), F.lit(1).alias("spans"), s["end"].cast("int").alias("end")))
    zero = F.struct(F.lit(0).alias("reach"))
    step = lambda a, x: F.struct(F.greatest(a["reach"], x["end"]).alias("reach"))
    kept = scan(F.array_sort(F.concat(points, begun)), zero, step, lambda before, x, after: F.when((x["spans"] == 0) & (before["reach"] <= x["at"]), x["at"]), "int")
    return F.filter(kept, lambda x: x.isNotNull())
