"""Matrices of characters: strings, comparison, sorting of rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.matrix import Matrix
from loomgraph.operators.ordering import numbered


def text(m: Matrix) -> DataFrame:
    """One row, s: all characters in row-major order."""
    return m.df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "v"))), lambda x: x["v"]), "").alias("s"))


def compare(a: Matrix, b: Matrix) -> int:
    """-1, 0 or 1, as the texts are ordered by code points."""
    x, y = text(a).first()[0], text(b).first()[0]
    return (x > y) - (x < y)


def less(a: Matrix, b: Matrix) -> bool:
    return compare(a, b) < 0


def greater(a: Matrix, b: Matrix) -> bool:
    return compare(a, b) > 0


def sort_rows(m: Matrix) -> Matrix:
    """Rows in the order of their texts; equal ones stay in order."""
    rows = m.df.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]), "").alias("s"))
    place = numbered(rows, "s", "i", name="to").drop("s")
    return Matrix(m.df.join(place, "i").select(F.col("to").alias("i"), "j", "v"), m.nrows, m.ncols, m.layout)


def sort_columns(m: Matrix) -> Matrix:
    return sort_rows(m.transpose()).transpose()
