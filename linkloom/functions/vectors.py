"""Vector functions on array columns, as built-in expressions in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def tanimoto(a: Column, b: Column) -> Column:
    """dot / (|a|^2 + |b|^2 - dot), 0 for two zero vectors."""
    d = dot(a, b)
    rest = dot(a, a) + dot(b, b) - d
    return F.when(rest == 0, 0.0).otherwise(d / rest)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def absolute_difference(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y))


def binarise(a: Column, threshold: float = 0.0) -> Column:
    return F.transform(a, lambda x: F.when(x > threshold, 1.0).otherwise(0.0))


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    near = F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: x)


def max_absolute_difference(a: Column, b: Column) -> Column:
    return F.array_max(absolute_difference(a, b))


def linear(weights: list[list[float]], bias: list[float], x: Column) -> Column:
    """W x + b for a small fixed matrix."""
    rows = [F.array(*[F.lit(float(w)) for w in row]) for row in weights]
    return F.array(*[dot(r, x) + float(b) for r, b in zip(rows, bias)])


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(_double(a), lambda x: F.when(n == 0, 0.0).otherwise(x / n))


def two_tower_score(wa: list[list[float]], ba: list[float], wb: list[list[float]], bb: list[float], a: Column, b: Column) -> Column:
    """Probability of a pair: sigmoid of the dot product of two linear projections."""
    return sigmoid(dot(linear(wa, ba, a), linear(wb, bb, b)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bin_label(x: Column, bounds: list[float]) -> Column:
    """Label of the left-closed bin of ``x``, with labels for below and above the bounds."""
    out = F.when(x < bounds[0], F.lit(f"<{bounds[0]:g}"))
    for low, high in zip(bounds, bounds[1:]):
        out = out.when((x >= low) & (x < high), F.lit(f"[{low:g}, {high:g})"))
    return out.otherwise(F.lit(f">{bounds[-1]:g}"))


def cosine_schedule(step: Column, total: int, start: float, end: float) -> Column:
    """Cosine annealing from ``start`` to ``end``."""
    return F.lit(end) + (start - end) * (1 + F.cos(F.lit(math.pi) * F.least(step, F.lit(total)) / total)) / 2


def warmup_schedule(step: Column, warmup: int, rate: float) -> Column:
    """Linear up to ``rate``."""
    return rate * F.least(F.lit(1.0), step / max(1, warmup))


def inverse_root_schedule(step: Column, warmup: int, width: int) -> Column:
    """width^-1/2 * min(step^-1/2, step * warmup^-3/2), from step 1 on."""
    at = F.greatest(step, F.lit(1)).cast("double")
    return F.lit(width**-0.5) * F.least(F.pow(at, F.lit(-0.5)), at * warmup**-1.5)
