"""Ordered walks over an array that give a result for each element.

What a lambda refers to from outside is worked out anew for each element unless it is a plain column or bound by :func:`bind`.

Appending to an array inside ``aggregate`` copies it each time, which is quadratic in a long array. Here the array is cut
into about as many pieces as a piece has elements; only a piece's own states and the list of pieces are ever copied. States are
gathered first, and what is emitted comes from them in one more pass, as binding each state costs more than the step itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces(items: Column) -> Column:
    """The array as an array of arrays, about the root of its size each."""

    def cut(a: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / width).cast("int") - 1, F.lit(0)))
        return F.transform(starts, lambda i: F.slice(a, i * width + 1, width))

    return bind(items, cut)


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """For each element ``emit(state before, element, state after)`` with ``after = step(before, element)``; null for a null array.

    ``zero`` is a struct of typed fields, ``kind`` the type of what is emitted.
    """
    last = lambda states: F.element_at(states, F.lit(-1))

    def block(acc: Column, part: Column) -> Column:
        walked = F.aggregate(part, F.array(acc["state"]), lambda states, x: F.array_append(states, step(last(states), x)))
        shown = lambda states: F.transform(part, lambda x, i: emit(F.get(states, i), x, F.get(states, i + 1)).cast(kind))
        return bind(walked, lambda states: F.struct(last(states).alias("state"), F.array_append(acc["out"], shown(states)).alias("out")))

    start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(pieces(items), start, block, lambda acc: F.flatten(acc["out"]))


def running_total(counts: Column, inclusive: bool = True) -> Column:
    """Running sums of an array of numbers as longs, with or without the element itself."""
    zero = F.struct(F.lit(0).cast("long").alias("n"))
    return scan(counts, zero, lambda s, x: F.struct((s["n"] + x).cast("long").alias("n")), lambda before, x, after: after["n"] if inclusive else before["n"], "bigint")


def runs_of(items: Column, labels: Column) -> Column:
    """The array cut where the label (not null, as many as items) changes."""

    def cut(a: Column, n: Column) -> Column:
        starts = F.filter(F.transform(n, lambda x, i: F.when((i == 0) | (F.get(n, i - 1) != x), i)), lambda i: i.isNotNull())
        return bind(starts, lambda s: F.transform(s, lambda at, k: F.slice(a, at + 1, F.coalesce(F.get(s, k + 1), F.size(n)) - at)))

    return bind(items, lambda a: bind(labels, lambda n: cut(a, n)))


def percentile_of(values: Column, percent: float) -> Column:
    """The interpolated percentile of an array of doubles without nulls; null for an empty one."""

    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(percent / 100)
        low = F.get(s, F.floor(place).cast("int"))
        return low + (F.get(s, F.ceil(place).cast("int")) - low) * (place - F.floor(place))

    return bind(F.array_sort(values), at)
