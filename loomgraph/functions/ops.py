"""Scalar operators as column expressions: unary, binary and comparison objects, and the catalogue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOATS = ("float", "double")
INTEGERS = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class UnaryOp:
    """A function of one column, applied by apply()."""

    expr: Callable[[Column], Column]

    def __call__(self, a: Column) -> Column:
        return self.expr(a)


@dataclass(frozen=True)
class BinaryOp:
    expr: Callable[[Column, Column], Column]

    def __call__(self, a: Column, b: Column) -> Column:
        return self.expr(a, b)


class BinaryOpToBool(BinaryOp):
    """A comparison."""


def zero_of(dtype: str) -> Column:
    """The value that sparse layouts leave out."""
    return F.lit({"string": "", "boolean": False}.get(dtype, 0)).cast(dtype)


def is_zero(a: Column, dtype: str) -> Column:
    return a == zero_of(dtype)


def divide(a: Column, b: Column, dtype: str = "double") -> Column:
    """Integers truncate towards zero, and fail at zero; floats follow IEEE (an unsigned zero divisor)."""
    if dtype in INTEGERS:
        return F.call_function("div", a, b)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    at_zero = F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(b == 0, at_zero).otherwise(a / F.when(b != 0, b))


addition = BinaryOp(lambda a, b: a + b)
subtraction = BinaryOp(lambda a, b: a - b)
multiplication = BinaryOp(lambda a, b: a * b)
division = BinaryOp(divide)
integer_division = BinaryOp(lambda a, b: divide(a, b, "bigint"))
first_argument = BinaryOp(lambda a, b: a)
second_argument = BinaryOp(lambda a, b: b)
minimum = BinaryOp(lambda a, b: F.least(a, b))
maximum = BinaryOp(lambda a, b: F.greatest(a, b))
equal = BinaryOpToBool(lambda a, b: a == b)
not_equal = BinaryOpToBool(lambda a, b: a != b)
greater_than = BinaryOpToBool(lambda a, b: a > b)
less_than = BinaryOpToBool(lambda a, b: a < b)
greater_than_or_equal = BinaryOpToBool(lambda a, b: a >= b)
less_than_or_equal = BinaryOpToBool(lambda a, b: a <= b)
logical_or = BinaryOpToBool(lambda a, b: a | b)
logical_and = BinaryOpToBool(lambda a, b: a & b)
logical_xor = BinaryOpToBool(lambda a, b: a != b)
logical_inverse = UnaryOp(lambda a: ~a)
negate = UnaryOp(lambda a: -a)
absolute = UnaryOp(F.abs)
square_root = UnaryOp(F.sqrt)


def power(exponent: float) -> UnaryOp:
    return UnaryOp(lambda a: F.pow(a, F.lit(float(exponent))))
