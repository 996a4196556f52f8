"""Vector expressions over array columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_distance(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two arrays of doubles of one length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def l2_normalize(v: str | Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    v = F.col(v) if isinstance(v, str) else v
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: F.when(n == 0, x).otherwise(x / n))


def signed_round(x: str | Column, digits: int) -> Column:
    """x rounded half away from zero; a negative number that rounds to zero gives -0.0, as SQL's engine has it."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(F.abs(x), digits) * F.signum(x)


def centered(v: str | Column) -> Column:
    """n points (arrays of one length) less their mean on each axis; no points stay none."""
    v = F.col(v) if isinstance(v, str) else v
    axes = F.sequence(F.lit(0), F.size(v[0]) - 1)
    mean = F.transform(axes, lambda i: F.aggregate(v, F.lit(0.0), lambda s, p: s + F.get(p, i)) / F.size(v))
    return F.when(F.size(v) == 0, v).otherwise(F.transform(v, lambda p: F.zip_with(p, mean, lambda x, m: x - m)))
