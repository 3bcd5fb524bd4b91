"""Walks over arrays of numbers on Arrow batches: the arrays of a batch are one flat vector, and where each begins in it.

Such a column can't stand inside a lambda; :mod:`~loomfold.functions.scans` has what can.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = -1


def flat(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of all arrays of a batch, and the offsets of the arrays in them; a null array has none."""
    at = a.offsets.to_numpy()
    return a.values.slice(at[0], at[-1] - at[0]), at - at[0]


def nested(a: pa.Array, offsets: np.ndarray, values: pa.Array) -> pa.Array:
    """Arrays of ``values``, null where those of ``a`` are."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=a.is_null() if a.null_count else None)


def totals(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Running sums that begin anew with each array, elements included."""
    upto = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return upto[1:] - np.repeat(upto[offsets[:-1]], np.diff(offsets))


def known(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as longs, 0 for null, and which are null."""
    void = values.is_null().to_numpy(zero_copy_only=False)
    return values.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), void


def running_total(counts: Column, inclusive: bool = True) -> Column:
    """Running sums of an array of whole numbers as longs, with or without the element itself; null from the first null on."""

    @F.arrow_udf("array<bigint>")
    def run(a: pa.Array) -> pa.Array:
        values, at = flat(a)
        x, void = known(values)
        own = 0 if inclusive else 1
        return nested(a, at, pa.array(totals(x, at) - own * x, mask=totals(void, at) - own * void > 0))

    return run(counts.cast("array<bigint>"))


def positions(valid: Column) -> Column:
    """Running count of valid places less one; 0 where not valid."""

    @F.arrow_udf("array<int>")
    def run(a: pa.Array) -> pa.Array:
        values, at = flat(a)
        x, void = known(values)
        own = x == 1
        return nested(a, at, pa.array(np.where(own, totals(x, at) - x, 0).astype(np.int32), mask=own & (totals(void, at) > 0)))

    return run(valid.cast("array<int>"))


def top_p_keep(logits: Column, p: float) -> Column:
    """Per place, whether it belongs to the fewest most likely ones whose mass reaches p (the first always does). A place without a score never does."""

    def keep(x: np.ndarray) -> np.ndarray:
        weights = np.exp(x - x.max()) if len(x) else x
        order = np.argsort(-x, kind="stable")  # ties to the earlier place
        # sums in order, as a fold has them
        total = np.add.accumulate(weights)[-1:]
        before = np.add.accumulate(np.concatenate([[0.0], (weights[order] / total)[:-1]])) if len(x) else x
        out = np.empty(len(x), bool)
        out[order] = before <= p
        return out

    @F.arrow_udf("array<boolean>")
    def run(a: pa.Array) -> pa.Array:
        values, at = flat(a)
        x = values.fill_null(-np.inf).to_numpy(zero_copy_only=False)
        kept = [keep(x[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        out = np.concatenate(kept) if kept else np.empty(0, bool)
        return nested(a, at, pa.array(out & ~values.is_null().to_numpy(zero_copy_only=False)))

    return run(logits.cast("array<double>"))


def edit_script(source: Column, target: Column) -> Column:
    """Edits of an alignment (equal lengths, -1 for a blank): kind, position in the source, token; null if a side is null.

    Called not deterministic, so that a filter on the edits isn't moved before them and all of it worked out twice.
    """
    kinds = pa.array(["INS", "DEL", "SUB"])

    @F.arrow_udf("array<struct<kind:string,pos:int,token:int>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        both = pc.and_(a.is_valid(), b.is_valid())
        (x, at), (y, other) = flat(a.filter(both)), flat(b.filter(both))
        if not np.array_equal(at, other):
            raise ValueError("the sides of an alignment have equal lengths")
        x, y = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)
        n = totals(x != BLANK, at) - 1
        edited = np.flatnonzero(x != y)
        x, y, n = x[edited], y[edited], n[edited]
        kind = np.where(x == BLANK, 0, np.where(y == BLANK, 1, 2))
        made = pa.StructArray.from_arrays([kinds.take(pa.array(kind)), pa.array(np.maximum(n, np.where(kind == 0, 0, n)).astype(np.int32)), pa.array(y.astype(np.int32), mask=kind == 1)], ["kind", "pos", "token"])
        # a pair of which a side is null has no edits here
        ends = np.zeros(len(a) + 1, np.int64)
        ends[1:][both.to_numpy(zero_copy_only=False)] = np.diff(np.searchsorted(edited, at))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), made, mask=pc.invert(both) if not pc.all(both).as_py() else None)

    return run.asNondeterministic()(source.cast("array<int>"), target.cast("array<int>"))
