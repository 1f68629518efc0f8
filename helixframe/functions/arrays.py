"""Column functions over numbers and arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col


def asinh_log2(v, scale) -> Column:
    """asinh(v / scale) / ln 2, by logarithms where the quotient overflows."""
    v, scale = col(v), col(scale)
    q = v / scale
    big = F.signum(v) * (F.ln(F.abs(v)) - F.ln(scale) + math.log(2)) / math.log(2)
    return F.when(F.abs(q) == float("inf"), big).otherwise(F.asinh(q) / math.log(2))


def log2_ratio(a, b, pseudo: float = 0.5) -> Column:
    return F.log2((col(a) + pseudo) / (col(b) + pseudo))


def log2_contrast(vr, vd, pr, pd) -> Column:
    """log2(vr / vd) - log2(pr / pd); null unless all four are positive."""
    x = [col(c) for c in (vr, vd, pr, pd)]
    positive = (x[0] > 0) & (x[1] > 0) & (x[2] > 0) & (x[3] > 0)
    return F.when(positive, F.log2(x[0]) - F.log2(x[1]) - F.log2(x[2]) + F.log2(x[3]))


def sigmoid(z) -> Column:
    z = col(z)
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def log1p_exp(z) -> Column:
    z = col(z)
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0))


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def half_up(x) -> Column:
    """Round half towards plus infinity."""
    return F.floor(col(x) + 0.5)


def lower_state(x, offset: float, scale: float, low: float, high: float, integer: bool = False) -> Column:
    value = clamp(offset + scale * col(x), low, high)
    return half_up(value) if integer else value


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def distance(a, b) -> Column:
    d = F.zip_with(col(a), col(b), lambda x, y: x - y)
    return F.sqrt(dot(d, d))


def angle(a, b) -> Column:
    """Radians; null where either vector is zero."""
    return F.acos(clamp(F.try_divide(dot(a, b), norm(a) * norm(b)), -1.0, 1.0))


def bit_mask(a) -> Column:
    """Sum of the distinct powers of two of an array of small numbers."""
    return F.aggregate(F.array_distinct(col(a)), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.expr("1L").cast("long") * F.pow(F.lit(2), x).cast("long")))


def centred(a) -> Column:
    """The array minus its mean."""
    a = col(a)
    mean = F.try_divide(F.aggregate(a, F.lit(0.0), lambda t, x: t + x), F.size(a))
    return F.transform(a, lambda x: x - mean)


def product(a) -> Column:
    """Exact at zeros, unlike exp(sum(ln))."""
    return F.aggregate(col(a), F.lit(1.0), lambda t, x: t * x)


def distance_bin(d, edges: list[float]) -> Column:
    """How many edges |d| reaches."""
    return sum(((F.abs(col(d)) >= e).cast("int") for e in edges), F.lit(0))


def label_of_max(values, names: list[str], threshold: float, other: str = "none") -> Column:
    """The name of the first greatest value, if above the threshold."""
    v = col(values)
    top = F.array_max(v)
    return F.when(top > threshold, F.element_at(F.array(*map(F.lit, names)), F.array_position(v, top).cast("int"))).otherwise(other)


def window_call(values, floor: float, first: int, size: int, wild_type, wild_floor: float) -> Column:
    """active, silent or qc_filtered from a slice of a profile: signs in the
    slice agree, its mean passes the floor, the wild type is measurable."""
    part = F.slice(col(values), first, size)
    mean = F.try_divide(F.aggregate(part, F.lit(0.0), lambda t, x: t + x), F.size(part))
    signs = F.array_distinct(F.transform(F.filter(part, lambda x: x != 0), lambda x: F.signum(x)))
    return F.when(col(wild_type) < wild_floor, "qc_filtered").when((F.abs(mean) >= floor) & (F.size(signs) == 1), "active").otherwise("silent")
