"""Vectors and fingerprints as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null where lengths differ or a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def resample(values: Column, bins: int) -> Column:
    """Linear interpolation of ``values`` to ``bins`` evenly spaced points, ends included."""
    last = F.size(values) - 1

    def at(i: Column) -> Column:
        pos = i.cast("double") * last / (bins - 1)
        lo = F.floor(pos).cast("int")
        hi = F.least(lo + 1, last)
        a, b = F.get(values, lo), F.get(values, hi)
        return a + (b - a) * (pos - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), at)


def band_sums(values: Column, bands: int, width: int) -> list[Column]:
    """Sum of each of ``bands`` consecutive stretches of ``width`` values."""
    return [F.aggregate(F.slice(values, b * width + 1, width), F.lit(0.0), lambda s, v: s + v.cast("double")) for b in range(bands)]


def mean_abs_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def fingerprint_distance(energy_a: Column, energy_b: Column, zcr_a: Column, zcr_b: Column, levels: float = 1.0) -> Column:
    """Weighted mean absolute difference of energy (0.6) and zero-crossing (0.4) bins, whose largest value is ``levels``."""
    return F.lit(0.6) * (mean_abs_difference(energy_a, energy_b) / levels) + F.lit(0.4) * (mean_abs_difference(zcr_a, zcr_b) / levels)
