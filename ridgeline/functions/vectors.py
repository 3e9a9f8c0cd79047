"""Vector and sequence expressions, all inside the JVM, and their numpy twins for batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of curve, first and second derivative, and the largest shift.
SEGMENT_WEIGHTS, MAX_SHIFT = (0.72, 0.20, 0.08), 10
#: Norms at or below this count as zero.
EPS32 = 1.1920929e-07


def let(value: Column, body) -> Column:
    """body of the value, which is evaluated once: a lambda's argument is bound, a repeated expression would be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length; unchanged if that is next to zero."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > EPS32, x.cast("double") / n).otherwise(x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Within [-1, 1]; 0 if either has no length."""
    raw = F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def resample(a: Column, n: int) -> Column:
    """n values at even distances, linear in between."""
    return let(a, lambda bound: _resampled(bound, n))


def _resampled(a: Column, n: int) -> Column:
    size = F.size(a)

    def at(i: Column) -> Column:
        x = i * (size - 1) / F.lit(max(1, n - 1))
        low = F.least(F.floor(x).cast("int"), size - 1)
        high = F.least(low + 1, size - 1)
        left, right = F.element_at(a, low + 1), F.element_at(a, high + 1)
        return left + (right - left) * (x - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def gradient(a: Column) -> Column:
    """Central differences, one-sided at both ends."""
    return let(a, _gradient)


def _gradient(a: Column) -> Column:
    n = F.size(a)

    def at(x: Column, i: Column) -> Column:
        return (
            F.when(n < 2, F.lit(0.0))
            .when(i == 0, F.element_at(a, F.lit(2)) - x)
            .when(i == n - 1, x - F.element_at(a, n - 1))
            .otherwise((F.element_at(a, F.least(i + 2, n)) - F.element_at(a, F.greatest(i, F.lit(1)))) / 2)
        )

    return F.transform(a, at)


def moving_average(a: Column, radius: int) -> Column:
    """Triangular weights; the window is cut at both ends."""
    return let(a, lambda bound: _moving_average(bound, radius))


def _moving_average(a: Column, radius: int) -> Column:
    n = F.size(a)

    def at(_: Column, i: Column) -> Column:
        js = F.sequence(F.greatest(i - radius, F.lit(0)), F.least(i + radius, n - 1))
        weight = total(F.transform(js, lambda j: (radius + 1 - F.abs(j - i)).cast("double")))
        return total(F.transform(js, lambda j: F.element_at(a, j + 1) * (radius + 1 - F.abs(j - i)))) / weight

    return F.transform(a, at)


def sequence_distance(a: Column, b: Column, fallback: float = 1.0) -> Column:
    """Mean absolute difference after both are brought to the longer length; 0 if both are empty, fallback if one is."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: _sequence_distance(s["a"], s["b"], fallback))


def _sequence_distance(a: Column, b: Column, fallback: float) -> Column:
    n = F.greatest(F.size(a), F.size(b))

    def at(x: Column, i: Column) -> Column:
        size = F.size(x)
        p = F.when(n > 1, i * (size - 1) / (n - 1)).otherwise(F.lit(0.0))
        low = F.least(F.floor(p).cast("int"), size - 1)
        left, right = F.element_at(x, low + 1), F.element_at(x, F.least(low + 2, size))
        return left + (right - left) * (p - low)

    gaps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.abs(at(a, i) - at(b, i)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(0.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(fallback)).otherwise(total(gaps) / n)


def area(a: Column) -> Column:
    """Trapezoids over an axis of length 1."""
    return (total(a) - (F.element_at(a, 1) + F.element_at(a, -1)) / 2) / (F.size(a) - 1)


def centre_of_mass(a: Column) -> Column:
    return total(F.transform(a, lambda x, i: x * i / (F.size(a) - 1))) / F.greatest(total(a), F.lit(float(np.finfo(float).eps)))


def roughness(a: Column) -> Column:
    return total(F.transform(F.sequence(F.lit(2), F.size(a)), lambda i: F.abs(F.element_at(a, i) - F.element_at(a, i - 1)))) / (F.size(a) - 1)


def log_profile(y: Column, floor: float) -> Column:
    """Decades above the floor, as a share of those that the largest value reaches (at least one decade)."""
    low = float(np.log10(floor))
    top = F.log10(F.greatest(F.array_max(y), F.lit(10 * floor))) - low
    return let(top, lambda t: F.transform(y, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log10(F.greatest(v, F.lit(floor))) - low) / t))))


def floor_quantile(a: Column, f: float) -> Column:
    """The sorted element at floor(f * n), the last at most; 0 for an empty array."""
    n = F.size(a)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.element_at(F.array_sort(a), F.least(n, F.floor(n * f).cast("int") + 1)))


def units(a: np.ndarray) -> np.ndarray:
    """Every row over its length; rows without length stay 0."""
    n = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(n > 0, n, np.inf)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of every row of a with every row of b; 0 where a row has no length."""
    return np.clip(units(a) @ units(b).T, -1.0, 1.0)


def aligned(a: np.ndarray, b: np.ndarray, max_shift: int = MAX_SHIFT) -> np.ndarray:
    """The best weighted cosine of three segments over all shifts, for every pair of rows; plain cosine where segments are too short."""
    n = a.shape[1]
    if n % 3 or n < 12:
        return cosines(a, b)
    size = n // 3
    most = min(max_shift, size // 2 - 1)
    best = np.full((len(a), len(b)), -np.inf)
    for shift in range(-most, most + 1):
        score = np.zeros_like(best)
        for k, weight in enumerate(SEGMENT_WEIGHTS):
            x, y = a[:, k * size : (k + 1) * size], b[:, k * size : (k + 1) * size]
            x, y = (x[:, shift:], y[:, : size - shift]) if shift >= 0 else (x[:, :shift], y[:, -shift:])
            score += weight * cosines(x, y)
        best = np.maximum(best, score)
    return np.clip(best, -1.0, 1.0)
