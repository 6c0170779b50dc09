"""Small linear algebra on array columns, shared by the forecast models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pivots below this share of their diagonal count as zero.
SINGULAR = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once: a lambda computes what it names each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, keep: Sequence, **columns: Column) -> DataFrame:
    """`keep` and `columns`, whose expressions later projections do not take apart again."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def triangle(x: Column) -> Column:
    """The upper triangle of x xᵀ, row by row."""
    return F.flatten(F.transform(x, lambda u, i: F.transform(F.slice(x, i + 1, F.size(x) - i), lambda v: u * v)))


def triangle_at(entries: Column, n: Column, i: Column, j: Column) -> Column:
    """Entry (i, j), from 0, of a symmetric n × n matrix stored as its upper triangle."""
    low, high = F.least(i, j), F.greatest(i, j)
    return F.get(entries, (low * n - F.floor(low * (low - 1) / 2) + high - low).cast("int"))


def solved(matrix: Column, k: Column, diagonal: Callable[[Column], Column]) -> Column:
    """The solution of k symmetric positive equations, `matrix` being their rows with the right-hand side at the
    end, by Gauss–Jordan elimination. An unknown whose pivot vanishes beside `diagonal(its number)` is 0."""
    def eliminate(a, c):
        pivot_row = F.get(a, c)

        def reduced(pivot):
            good = pivot > SINGULAR * diagonal(c)
            return F.transform(a, lambda row, i: F.when(i == c, F.transform(row, lambda v: F.when(good, v / pivot).otherwise(F.lit(0.0))))
                               .when(good, F.zip_with(row, pivot_row, lambda v, w: v - F.get(row, c) / pivot * w)).otherwise(row))
        return let(F.get(pivot_row, c), reduced)
    return let(matrix, lambda m: F.aggregate(F.sequence(F.lit(0), k - 1), m, eliminate,
                                             lambda a: F.transform(a, lambda row: F.element_at(row, -1))))
