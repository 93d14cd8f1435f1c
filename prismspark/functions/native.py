"""Spectral kernels as Catalyst expressions over an ``array<double>`` column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once a row: a lambda variable is
    bound to it, so it is not repeated inside the lambdas of ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(x: Column, of: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + of(v))


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def std_pop(x: Column, m: Column) -> Column:
    return F.sqrt(F.try_divide(total(x, lambda v: (v - m) * (v - m)), F.size(x)))


def peak(x: Column) -> Column:
    """Largest absolute value."""
    return F.array_max(F.transform(x, F.abs))


def standardized(x: Column, floor: float = 1e-3, added: float = 0.0) -> Column:
    """(v - mean) / (max(population std, floor) + added)."""
    return let(mean(x), lambda m: let(F.greatest(std_pop(x, m), F.lit(floor)) + added, lambda s: F.transform(x, lambda v: (v - m) / s)))


def finite_or_zero(x: Column) -> Column:
    return F.transform(x, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def finite_or(x: Column, original: Column) -> Column:
    """``original`` where any channel of ``x`` is not finite."""
    return F.when(F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), original).otherwise(x)


def instance_norm(x: Column, eps: float = 1e-5) -> Column:
    """(v - mean) / sqrt(population variance + eps)."""
    return let(mean(x), lambda m: let(F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m))) + eps), lambda s: F.transform(x, lambda v: (v - m) / s)))


def unit_norm(x: Column, order: float = 2, floor: float = 1e-12) -> Column:
    """x over its L-``order`` norm (1: area)."""
    size = total(x, F.abs) if order == 1 else F.sqrt(total(x, lambda v: v * v)) if order == 2 else F.pow(total(x, lambda v: F.pow(F.abs(v), F.lit(float(order)))), F.lit(1.0 / order))
    return let(F.greatest(size, F.lit(floor)), lambda n: F.transform(x, lambda v: v / n))


def take(x: Column, channels: Sequence[int]) -> Column:
    """The given channels, in that order."""
    return F.transform(F.array(*[F.lit(int(c)) for c in channels]), lambda i: F.get(x, i))


def window_channels(axis: Sequence[float], keep: Sequence[tuple[float, float]]) -> list[int]:
    """Channels inside any of the windows (ends included), in axis order."""
    found = [c for c, v in enumerate(axis) if any(lo <= v <= hi for lo, hi in keep)]
    if keep and not found:
        raise ValueError("crop kept 0 channels")
    return found if keep else list(range(len(axis)))


def brackets(axis: Sequence[float], targets: Sequence[float], clamp: bool = False) -> list[tuple[int, int, float]]:
    """(left channel, right channel, weight of the right one) of each target on
    an axis in either direction; outside the axis an error, or with ``clamp``
    the nearest channel."""
    order = sorted(range(len(axis)), key=lambda c: axis[c])
    points, out = [axis[c] for c in order], []
    for t in targets:
        if not points[0] <= t <= points[-1]:
            if not clamp:
                raise ValueError(f"{t} is {'below' if t < points[0] else 'above'} the interpolation range")
            t = min(max(t, points[0]), points[-1])
        k = next((i for i in range(1, len(points)) if t <= points[i]), len(points) - 1)
        step = points[k] - points[k - 1]
        out.append((order[k - 1], order[k], (t - points[k - 1]) / step if step else 0.0))
    return out


def interpolate(x: Column, axis: Sequence[float], targets: Sequence[float], clamp: bool = False) -> Column:
    """Linear interpolation; the weights are worked out once, on the driver."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in brackets(axis, targets, clamp)])
    return F.transform(steps, lambda s: F.get(x, s["a"]) * (1 - s["w"]) + F.get(x, s["b"]) * s["w"])


def softmax(x: Column) -> Column:
    return let(F.array_max(x), lambda m: let(F.transform(x, lambda v: F.exp(v - m)), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s))))


def argmax(p: Column) -> Column:
    """Place of the largest value, the first of equals, from 0."""
    return F.array_position(p, F.array_max(p)) - 1


def top_k(p: Column, k: int) -> Column:
    """Array of (cls, prob), by probability, ties to the smaller class."""
    keyed = F.transform(p, lambda v, i: F.struct((-v).alias("neg"), i.cast("int").alias("cls")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: F.struct(s["cls"].alias("cls"), (-s["neg"]).alias("prob")))


def lower_median(x: Column) -> Column:
    return let(F.array_sort(x), lambda s: F.get(s, F.expr("0") + ((F.size(x) - 1) / 2).cast("int")))


def differences(x: Column) -> Column:
    """First differences along the axis."""
    return F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda b, a: b - a)


def add_profile(x: Column, profile: Column, amount: Column | float = 1.0) -> Column:
    return F.zip_with(x, profile, lambda v, b: v + amount * b)
