"""How far a curve is from a regular, symmetric distribution of several states, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions import vectors

# What each part is divided by, its weight, and state counts there are.
SPACING, WIDTH, RATIO, SYMMETRY, ROUGHNESS, RADIUS, STATES = 0.55, 0.75, 0.75, 0.35, 0.08, 6, (1, 20)
WEIGHTS = {"states": 0.30, "spacing": 0.17, "width": 0.13, "valleys": 0.13, "symmetry": 0.11, "slopes": 0.07, "overlap": 0.05, "roughness": 0.04}


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def mean(a: Column) -> Column:
    """0 for no values."""
    return F.when(F.size(a) > 0, vectors.total(a) / F.size(a)).otherwise(0.0)


def variation(a: Column) -> Column:
    """The standard deviation over the mean; 0 for fewer than two values or a mean that isn't above 0."""
    m = mean(a)
    spread = vectors.let(m, lambda n: F.sqrt(mean(F.transform(a, lambda x: (x - n) * (x - n)))))
    return F.when((F.size(a) < 2) | (m <= 1e-9), 0.0).otherwise(spread / m)


def asymmetry(profile: Column, locations: Column) -> Column:
    """The mean difference of a profile on both sides of its peaks, each up to half way to the next one."""
    n = F.size(profile)
    at = F.transform(locations, lambda x: F.floor(x * (n - 1) + 0.5).cast("int"))

    def around(p: Column, i: Column) -> Column:
        low = F.when(i > 0, F.floor((F.get(at, i - 1) + p) / 2)).otherwise(0)
        high = F.when(i + 1 < F.size(at), F.ceil((p + F.get(at, i + 1)) / 2)).otherwise(n - 1)
        radius = F.least(p - low, high - p).cast("int")
        gaps = F.transform(F.sequence(F.lit(1), F.greatest(radius, F.lit(1))), lambda k: F.abs(F.get(profile, p - k) - F.get(profile, p + k)))
        return F.when(radius < 2, 0.0).otherwise(mean(gaps))

    return mean(F.transform(at, around))


def irregularity(profile: Column, d: Column) -> Column:
    """From 0 to 1, of a profile and its descriptor: state counts, and sequences of peaks, widths, valleys and slopes."""
    peaks, widths, slopes = d["peak_locations"], d["peak_widths"], d["tail_slopes"]
    seen, states = d["observed_peak_count"], d["peak_count"]
    mismatch = F.when(d["regularized"], clamp(0.25 + F.abs(seen - states) / F.greatest(F.lit(1), seen, states))).otherwise(0.0)
    invalid = F.when(F.coalesce(states.between(*STATES), F.lit(False)), 0.0).otherwise(1.0)
    spacings = F.transform(F.slice(peaks, F.lit(2), F.greatest(F.size(peaks) - 1, F.lit(0))), lambda x, i: x - F.get(peaks, i))
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.floor(F.size(slopes) / 2).cast("int") - 1, F.lit(0))), lambda i: 2 * i + 1 < F.size(slopes))
    parts = {
        "states": F.greatest(mismatch, invalid), "spacing": clamp(variation(spacings) / SPACING), "width": clamp(variation(widths) / WIDTH),
        "valleys": clamp(mean(F.transform(d["valley_position_ratios"], lambda r: F.abs(r - 0.5) * 2)) / RATIO), "symmetry": clamp(asymmetry(profile, peaks) / SYMMETRY),
        "slopes": clamp(mean(F.transform(pairs, lambda i: F.abs(F.get(slopes, 2 * i) - F.get(slopes, 2 * i + 1)) / F.greatest(F.lit(1e-6), F.get(slopes, 2 * i) + F.get(slopes, 2 * i + 1))))),
        "overlap": clamp(mean(d["valley_heights"])), "roughness": clamp(mean(F.zip_with(profile, vectors.moving_average(profile, RADIUS), lambda x, y: F.abs(x - y))) / ROUGHNESS),
    }
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * parts[name]
    return clamp(total)
