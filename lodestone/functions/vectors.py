"""Vectors as Catalyst expressions: norms, unit vectors and 8-bit codes with one scale for each vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 127


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: an expression that a lambda names is computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def norm(v: Column) -> Column:
    """Of 32-bit floats, in 64 bits."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """A unit vector of 32-bit floats; a zero vector stays."""
    return let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float"))))


def quantize(v: Column) -> Column:
    """struct<scale: float, codes: array<tinyint>> of the unit vector. Halves round up, as towards +infinity."""

    def coded(unit: Column, peak: Column) -> Column:
        codes = F.transform(unit, lambda x: F.when(peak == 0, F.lit(0)).otherwise(F.floor(x.cast("double") / peak * LIMIT + 0.5)).cast("tinyint"))
        return F.struct((peak / LIMIT).cast("float").alias("scale"), codes.alias("codes"))

    def largest(unit: Column) -> Column:
        return F.array_max(F.transform(unit, lambda x: F.abs(x.cast("double"))))

    return let(l2_normalize(v), lambda unit: let(largest(unit), lambda peak: coded(unit, peak)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def of_width(v: Column, dims: int) -> Column:
    """v, or an error where its width is another."""
    wrong = F.raise_error(F.concat(F.lit("vector has width "), F.size(v).cast("string"), F.lit(f", not {dims}")))
    return F.when(F.size(v) == dims, v).otherwise(wrong.cast("array<float>"))
