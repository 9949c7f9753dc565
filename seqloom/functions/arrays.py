"""Expressions on numeric arrays: interpolation, padding, scaling, slopes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def missing_to_null(x: Column) -> Column:
    """NaN to NULL, so that aggregates skip it."""
    return F.nanvl(x, F.lit(None).cast("double"))


def at_position(values: Column, p: Column) -> Column:
    """Linear interpolation of an array at a fractional 0-based index inside it."""
    n = F.size(values)
    low = F.least(F.floor(p).cast("int"), n - 1)
    high = F.least(low + 1, n - 1)
    a, b = F.element_at(values, low + 1), F.element_at(values, high + 1)
    return a + (b - a) * (p - low)


def linspace_positions(n: Column, k: int) -> Column:
    """k even positions from 0 to n-1."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i * (n - 1).cast("double") / F.lit(float(max(k - 1, 1))))


def resampled(values: Column, k: int) -> Column:
    """An array of n values stretched to k by linear interpolation; empty stays empty."""
    stretch = lambda v: F.transform(linspace_positions(F.size(v), k), lambda p: at_position(v, p))
    return let(values, lambda v: F.when(F.size(v) > 0, stretch(v)).otherwise(F.array().cast("array<double>")))


def padded(values: Column, k, fill: Column) -> Column:
    """First k values, filled up at the end."""
    k = F.lit(k) if not isinstance(k, Column) else k
    return F.concat(F.slice(values, 1, k), F.array_repeat(fill, F.greatest(k - F.size(values), F.lit(0)).cast("int")))


def edge_padded(values: Column, k) -> Column:
    return F.when(F.size(values) > 0, padded(values, k, F.element_at(values, -1))).otherwise(values)


def fitted(values: Column, k: int) -> Column:
    """NaN-padded if short, else resampled to k."""
    return let(values, lambda v: F.when(F.size(v) <= k, padded(v, k, F.lit(NAN))).otherwise(resampled(v, k)))


def normalised(values: Column) -> Column:
    """Scaled to 0..1 by the known values; unchanged if they don't vary."""

    def scaled(v: Column) -> Column:
        known = F.filter(v, lambda x: ~F.isnan(x))
        bounds = F.struct(F.array_min(known).alias("low"), F.array_max(known).alias("high"))
        return let(bounds, lambda b: F.when(b["high"] > b["low"], F.transform(v, lambda x: (x - b["low"]) / (b["high"] - b["low"]))).otherwise(v))

    return let(values, scaled)


def slopes(values: Column, step: float) -> Column:
    """Forward differences over a grid of even steps; the last repeats the one before."""

    def of(v: Column) -> Column:
        n = F.size(v)
        inner = F.transform(F.sequence(F.lit(1), n - 1), lambda i: (F.element_at(v, i + 1) - F.element_at(v, i)) / F.lit(step))
        return F.when(n > 1, let(inner, lambda d: F.concat(d, F.array(F.element_at(d, -1))))).otherwise(F.transform(v, lambda _: F.lit(0.0)))

    return let(values, of)


def segments(values: Column, length: int, stride: int) -> Column:
    """Array of (start, segment) for each whole window of ``length``."""
    starts = F.when(F.size(values) >= length, F.sequence(F.lit(0), F.size(values) - length, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(values, s + 1, F.lit(length)).alias("values")))


def even_subsample(values: Column, k: int) -> Column:
    """All values if there are at most k, else those at the truncated even positions."""
    picked = lambda v: F.transform(linspace_positions(F.size(v), k), lambda p: F.element_at(v, F.floor(p).cast("int") + 1))
    return let(values, lambda v: F.when(F.size(v) <= k, v).otherwise(picked(v)))
