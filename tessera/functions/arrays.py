"""Small-array and text functions as column expressions (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def scaled(a: Column, by) -> Column:
    return F.transform(a, lambda x: x * by)


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mat_vec(m: Column, v: Column) -> Column:
    """Rows of `m` (an array of arrays) times `v`."""
    return F.transform(m, lambda row: dot(row, v))


def transposed(m: Column) -> Column:
    return F.array(*[F.transform(m, lambda row: row[j]) for j in range(3)])


def mat_mat(a: Column, b: Column) -> Column:
    """Product of two 3x3 matrices."""
    return F.transform(a, lambda row: F.array(*[sum((row[k] * b[k][j] for k in range(1, 3)), row[0] * b[0][j]) for j in range(3)]))


def det3(m: Column) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def inv3(m: Column) -> Column:
    """Inverse of a 3x3 matrix; null if it is singular."""
    adjugate = F.array(cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1]))
    d = det3(m)
    return F.when(d != 0, F.transform(transposed(adjugate), lambda row: scaled(row, 1 / d)))


def unique_sorted(a: Column) -> Column:
    """Distinct entries that are not negative, in order."""
    return F.array_sort(F.array_distinct(F.filter(a, lambda x: x >= 0)))


def merged(a: Column, b: Column) -> Column:
    """Union of two sorted arrays, sorted."""
    return F.array_sort(F.array_union(a, b))


def nastran_real(text: Column) -> Column:
    """Reals of bulk data: D for E, an exponent without a letter (`4.-4`), blank for 0."""
    t = F.regexp_replace(F.upper(F.trim(text)), "D", "E")
    bare = F.regexp_replace(t, r"^([+-]?[0-9.]+)([+-][0-9]+)$", "$1E$2")
    return F.coalesce(bare.try_cast("double"), F.lit(0.0))
