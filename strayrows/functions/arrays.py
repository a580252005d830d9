"""Row-local vector arithmetic on array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once.

    Column expressions are trees, so naming an expression twice would evaluate
    it twice, inside a lambda once per element; a lambda variable does not.
    """
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda v: v * v)))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def share(a: Column) -> Column:
    """Entries divided by their sum, 0 where the sum is 0."""
    return let(total(a), lambda t: F.transform(a, lambda v: safe_divide(v, t)))


def unit(a: Column) -> Column:
    """Entries divided by the Euclidean norm, 0 where it is 0."""
    return let(a, lambda b: let(norm(b), lambda n: F.transform(b, lambda v: safe_divide(v, n))))


def safe_divide(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def linspace(lo: Column, hi: Column, n: int) -> Column:
    """n evenly spaced values from lo to hi."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / F.lit(n - 1)
    )
