"""Small dense matrices as Columns: array<array<double>>, one row of the table each, no Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(matrix: Column, i: int, j: int) -> Column:
    return F.get(F.get(matrix, F.lit(i)), F.lit(j))


def vector(values: Sequence[Column | float]) -> Column:
    return F.array(*(v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in values))


def constant(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*(vector(r) for r in rows))


def diagonal(values: Sequence[float]) -> Column:
    return constant([[v if i == j else 0.0 for j in range(len(values))] for i, v in enumerate(values)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def times(matrix: Column, vec: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, vec))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p + q))


def scaled(matrix: Column, by: Column) -> Column:
    return F.transform(matrix, lambda row: F.transform(row, lambda x: x * by))


def added(a: Column, b: Column, by: Column | None = None) -> Column:
    """a + by * b of vectors."""
    return F.zip_with(a, b, (lambda x, y: x + y) if by is None else (lambda x, y: x + by * y))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def quadratic(matrix: Column, vec: Column) -> Column:
    return dot(times(matrix, vec), vec)


def inner(a: Column, b: Column) -> Column:
    """The sum of the products of two matrices' entries: the trace of a b for symmetric ones."""
    return F.aggregate(F.zip_with(a, b, dot), F.lit(0.0), lambda s, x: s + x)


def inverse(matrix: Column, size: int) -> Column:
    """struct(x, logdet): the inverse of a symmetric positive definite matrix, and the log of its determinant.

    Gauss-Jordan steps as a fold over the pivots, which are the squares of the Cholesky factor's diagonal: none needs
    to be looked for.  A matrix that isn't positive definite has null entries.
    """
    wide = F.zip_with(matrix, diagonal([1.0] * size), lambda row, unit: F.concat(row, unit))

    def step(acc: Column, k: Column) -> Column:
        def with_row(row: Column) -> Column:
            pivot = F.when(F.get(row, k) > 0, F.get(row, k))
            return let(
                F.struct(F.transform(row, lambda x: x / pivot).alias("row"), F.ln(pivot).alias("ln")),
                lambda p: F.struct(
                    F.transform(acc["m"], lambda r, i: F.when(i == k, p["row"]).otherwise(F.zip_with(r, p["row"], lambda x, y: x - F.get(r, k) * y))).alias("m"),
                    (acc["logdet"] + p["ln"]).alias("logdet"),
                ),
            )

        return let(F.get(acc["m"], k), with_row)

    start = F.struct(wide.alias("m"), F.lit(0.0).alias("logdet"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, step, lambda acc: F.struct(F.transform(acc["m"], lambda r: F.slice(r, size + 1, size)).alias("x"), acc["logdet"].alias("logdet")))


def cholesky(matrix: Column, size: int) -> Column:
    """The lower factor, row by row; null entries where the matrix isn't positive definite."""

    def entry(rows: Column, row: Column, i: Column, j: Column) -> Column:
        left = F.get(F.get(matrix, i), j) - F.coalesce(dot(F.slice(row, 1, j), F.slice(F.when(i == j, row).otherwise(F.get(rows, j)), 1, j)), F.lit(0.0))
        return F.when(i == j, F.sqrt(F.when(left > 0, left))).otherwise(left / F.get(F.get(rows, j), j))

    def line(rows: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), i), F.slice(vector([0.0]), 1, 0), lambda row, j: F.concat(row, F.array(entry(rows, row, i, j))))

    empty = F.slice(F.array(vector([0.0])), 1, 0)
    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), empty, lambda rows, i: F.concat(rows, F.array(line(rows, i))))
    return F.transform(done, lambda r: F.concat(r, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(r))))
