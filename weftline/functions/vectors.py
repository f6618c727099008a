"""Vector functions on array<float> columns, summed in double precision in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_D = "array<double>"


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a.cast(_D), b.cast(_D), lambda x, y: x * y))


def norm(v: Column) -> Column:
    """F19"""
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """to length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v.cast(_D)).otherwise(F.transform(v.cast(_D), lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """cosine similarity, 0 where a side has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a.cast(_D), b.cast(_D), lambda x, y: (x - y) * (x - y))
    return F.sqrt(total(d))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a.cast(_D), b.cast(_D), lambda x, y: F.abs(x - y)))


def resize(v: Column, n: int) -> Column:
    """cut or padded with zeros to n elements."""
    return F.slice(F.concat(v.cast(_D), F.array_repeat(F.lit(0.0), n)), 1, n)


def usable(v: Column, n: int | None = None) -> Column:
    """Not null, of n elements, all finite, not all zero."""
    fin = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & fin & F.exists(v, lambda x: x != 0)
    return ok if n is None else ok & (F.size(v) == n)


def quantize(v: Column) -> Column:
    """Elements times 127, rounded, as 8-bit integers of a vector of length 1."""
    return F.transform(normalize(v), lambda x: F.round(x * 127).cast("tinyint"))


def mean_columns(v: str, n: int, how: str = "avg", weight: str | None = None) -> list[Column]:
    """One aggregate for each of n elements, so rows need not be exploded: avg, sum, median, or the weighted average."""
    out = []
    for i in range(n):
        x = F.col(v)[i].cast("double")
        if weight:
            e = F.sum(x * F.col(weight)) / F.sum(F.col(weight))
        else:
            e = {"avg": F.avg, "sum": F.sum, "median": F.median}[how](x)
        out.append(e.alias(f"_{i}"))
    return out


def pack(n: int) -> Column:
    return F.array(*[F.col(f"_{i}") for i in range(n)])
