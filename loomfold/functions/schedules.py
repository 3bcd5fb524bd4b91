"""Masking schedules as column mathematics, looked up by name without regard to case."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-6


def _alpha(name: str, t: Column) -> tuple[Column, Column]:
    """(alpha, its derivative)."""
    kinds = {
        "linear": lambda: (1 - t, F.lit(-1.0)),
        "cosine": lambda: (1 - F.cos(F.lit(math.pi / 2) * (1 - t)), F.lit(-math.pi / 2) * F.sin(F.lit(math.pi / 2) * (1 - t))),
    }
    return _pick(kinds, name)()


def _kappa(name: str, t: Column, a: float, b: float) -> tuple[Column, Column]:
    kinds = {
        "cubic": lambda: ((a + 1) * F.pow(t, F.lit(3)) - (a + b + 1) * F.pow(t, F.lit(2)) + (b + 1) * t, 3 * (a + 1) * t * t - 2 * (a + b + 1) * t + (b + 1)),
        "linear": lambda: (t, F.lit(1.0)),
        "cosine": lambda: (1 - F.cos(F.lit(math.pi / 2) * t), F.lit(math.pi / 2) * F.sin(F.lit(math.pi / 2) * t)),
    }
    return _pick(kinds, name)()


def _pick(kinds: dict, name: str):
    if name.lower() not in kinds:
        raise ValueError(f"no schedule {name!r}; there are {', '.join(kinds)}")
    return kinds[name.lower()]


def _inside(t: Column) -> Column:
    """t, or an error outside [0, 1]."""
    return F.when(t.between(0, 1), t).otherwise(F.raise_error(F.lit("t must lie in [0, 1]")).cast("double"))


def alpha(name: str, t: Column) -> Column:
    return _alpha(name, _inside(t))[0]


def alpha_weight(name: str, t: Column) -> Column:
    value, slope = _alpha(name, _inside(t))
    return -slope / (1 - value + TINY)


def reverse_mask_probability(name: str, s: Column, t: Column) -> Column:
    """The chance that what is masked at t still is at s < t."""
    if_ok = F.when(s < t, (1 - _alpha(name, _inside(s))[0]) / (1 - _alpha(name, _inside(t))[0]))
    return if_ok.otherwise(F.raise_error(F.lit("s must be below t")).cast("double"))


def kappa(name: str, t: Column, a: float = 1.0, b: float = 1.0) -> Column:
    return _kappa(name, _inside(t), a, b)[0]


def kappa_weight(name: str, t: Column, a: float = 1.0, b: float = 1.0) -> Column:
    value, slope = _kappa(name, _inside(t), a, b)
    return slope / (1 - value + TINY)


def even_steps(total: Column, steps: int) -> Column:
    """The total dealt to steps, the first ones taking one more."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.floor(total / steps).cast("int") + (i < total % steps).cast("int"))


def transfer_steps(total: Column, steps: int, name: str = "linear") -> Column:
    """Expected places to fill in each step, rounded half to even from what is still open; steps of none are left out."""
    times = F.sequence(F.lit(steps), F.lit(1), F.lit(-1))
    zero = F.struct(total.cast("int").alias("left"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        share = 1 - reverse_mask_probability(name, (t - 1) / F.lit(float(steps)), t / F.lit(float(steps)))
        n = F.bround(acc["left"] * share).cast("int")
        return F.struct((acc["left"] - n).alias("left"), F.when(n > 0, F.array_append(acc["out"], n)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(times, zero, step, lambda a: a["out"])
