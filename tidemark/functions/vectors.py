"""Vectors quantized to one signed byte a dimension: a unit value is 127, a unit vector's square 16129."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 127
SQUARE = UNIT * UNIT
# Fixed values.
DEFAULT_THRESHOLD, LEAST_THRESHOLD, MOST_THRESHOLD = 0.38, 0.2, 1.0


def _bounded(v: Column) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(-127.0), F.least(F.lit(127.0), v)).cast("int"))


def quantize_index(vector: Column) -> Column:
    """array<int> codes of a stored vector, halves to even."""
    return F.transform(vector, lambda x: _bounded(F.rint(x.cast("double") * UNIT)))


def quantize_query(vector: Column) -> Column:
    """Codes of a searched vector, made a unit vector first, halves upward."""
    return F.transform(normalized(vector), lambda x: _bounded(F.floor(x * UNIT + 0.5).cast("double")))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(vector: Column) -> Column:
    """A zero vector stays zero."""
    n = norm(vector)
    return F.transform(vector, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    """Of two code arrays, as a long."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)


def packed(codes: Column) -> Column:
    """Codes as one byte each, in a binary column."""
    return F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(F.pmod(c, F.lit(256))), 2, "0")), ""))


def clamp_threshold(raw: object, fallback: float = DEFAULT_THRESHOLD) -> float:
    """An absent or unreadable threshold is the fallback; an empty one counts as zero."""
    if raw is None:
        return fallback
    try:
        value = float(raw) if str(raw).strip() else 0.0
    except ValueError:
        return fallback
    return min(MOST_THRESHOLD, max(LEAST_THRESHOLD, value)) if math.isfinite(value) else fallback


def clamp_limit(raw: object, fallback: int, most: int) -> int:
    try:
        value = float(raw) if raw is not None and str(raw).strip() else math.nan
    except ValueError:
        value = math.nan
    whole = math.floor(value) if math.isfinite(value) else 0
    return min(most, whole) if whole >= 1 else fallback
