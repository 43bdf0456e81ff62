"""Folds and set functions over nested arrays, as native higher-order functions.

These replace the reference's in-row SQL functions: ``within_table`` (a
sequence of queries over an array of structs), ``within`` (its scalar form),
``collect_all``, ``collect_distinct`` and ``array_union``.  Everything is a
Catalyst expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_sums(arr: Column | str, fields: Sequence[str], dtype: str = "bigint") -> Column:
    """Struct of SQL ``sum(field)`` over the elements of ``arr``.

    Same NULL rules as SQL ``sum``: NULL elements are skipped, and the sum of
    no values (empty array, NULL array, all elements NULL) is NULL.
    """
    init = F.struct(*[F.lit(None).cast(dtype).alias(f) for f in fields])

    def merge(acc: Column, x: Column) -> Column:
        return F.struct(*[
            F.when(x[f].isNull(), acc[f])
            .otherwise(F.coalesce(acc[f], F.lit(0).cast(dtype)) + x[f].cast(dtype))
            .alias(f)
            for f in fields
        ])

    return F.aggregate(_c(arr), init, merge)


def within(arr: Column | str, fields: Sequence[str],
           formula: Callable[[Column], Column]) -> Column:
    """Scalar in-row query: sum ``fields`` over the array, then apply ``formula``
    to the struct of sums.  NULL array -> NULL."""
    sums = fold_sums(arr, fields)
    return F.when(_c(arr).isNull(), F.lit(None)).otherwise(formula(sums))


def find_first(arr: Column | str, pred: Callable[[Column], Column]) -> Column:
    """First element satisfying ``pred``, or NULL (safe on empty arrays)."""
    return F.try_element_at(F.filter(_c(arr), pred), F.lit(1))


def collect_distinct(col: Column | str) -> Column:
    """Sorted array of the distinct non-NULL values of a group (deterministic)."""
    return F.sort_array(F.collect_set(_c(col)))


def null_safe_array_union(a: Column | str, b: Column | str, element_type: str = "string") -> Column:
    """Set union of two arrays; a missing (NULL) array counts as empty.
    NULL only when both are NULL."""
    a, b = _c(a), _c(b)
    empty = F.array().cast(f"array<{element_type}>")
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
        F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))
