"""Monoids and semirings. Known monoids become native aggregates; any other folds a sorted list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import ops

INF = float("inf")


@dataclass(frozen=True)
class Monoid:
    """An operator with its identity; native is the aggregate that does the same, if there is one."""

    zero: object
    op: ops.BinaryOp
    native: Callable[[Column], Column] | None = None
    dtype: str = "double"

    def identity(self) -> Column:
        return F.lit(self.zero).cast(self.dtype)

    def aggregate(self, value: Column, *order: Column) -> Column:
        """Folds a group's values from the identity, in the given order where there is no native aggregate."""
        if self.native is not None:
            return F.coalesce(self.op(self.identity(), self.native(value)), self.identity())
        rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], value.cast(self.dtype).alias("value"))))
        return F.aggregate(rows, self.identity(), lambda acc, row: self.op(acc, row["value"]).cast(self.dtype))

    def reduce(self, array: Column) -> Column:
        """Folds an array's elements, left to right."""
        return F.aggregate(array, self.identity(), lambda acc, x: self.op(acc, x).cast(self.dtype))


@dataclass(frozen=True)
class Semiring:
    """add folds the products of multiply. annihilates: a product with add's identity is that identity, so rows that hold it need no product."""

    add: Monoid
    multiply: ops.BinaryOp
    annihilates: bool = True

    @property
    def zero(self) -> object:
        return self.add.zero


def plus(dtype: str = "double") -> Monoid:
    return Monoid(0, ops.addition, F.sum, dtype)


def least(dtype: str = "double", zero: object = INF) -> Monoid:
    return Monoid(zero, ops.minimum, F.min, dtype)


def greatest(dtype: str = "double", zero: object = -INF) -> Monoid:
    return Monoid(zero, ops.maximum, F.max, dtype)


def either() -> Monoid:
    return Monoid(False, ops.logical_or, F.bool_or, "boolean")


def both() -> Monoid:
    return Monoid(True, ops.logical_and, F.bool_and, "boolean")


def plus_times(dtype: str = "double") -> Semiring:
    return Semiring(plus(dtype), ops.multiplication)


def min_plus(dtype: str = "double", zero: object = INF) -> Semiring:
    """Shortest paths; for integers give the value that stands for no path."""
    return Semiring(least(dtype, zero), ops.addition, annihilates=dtype in ops.FLOATS)


def max_min(dtype: str = "double", zero: object = -INF) -> Semiring:
    """Widest paths."""
    return Semiring(greatest(dtype, zero), ops.minimum)


def or_and() -> Semiring:
    """Reachability."""
    return Semiring(either(), ops.logical_and)


#: Default monoids of reductions: sums, and the maximum that starts at 0 (so columns of negative values give 0).
DEFAULT_ADD = plus()
DEFAULT_MAX = greatest(zero=0)
