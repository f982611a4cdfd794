"""Dense vectors as array<double> columns, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def scale(v: Column, c: Column) -> Column:
    return F.transform(v, lambda x: x * c)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def block(v: Column, start: int, size: int) -> Column:
    return F.slice(v, start + 1, size)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def coin(i: Column, j: Column, seed: int) -> Column:
    """A projection's entry in units of sqrt(3 / k): -1, 0 or 1 with chances 1/6, 2/3, 1/6, by integer arithmetic."""
    mixed = F.pmod((i * 7919 + 13) * (j * 104729 + 17) + F.lit(seed * 31337) + i * j * 31, F.lit(1000003)) % 6
    return F.when(mixed == 0, F.lit(-1)).when(mixed == 5, F.lit(1)).otherwise(F.lit(0))
