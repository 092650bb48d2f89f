"""Reductions by monoids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.algebra import DEFAULT_MAX, Monoid, greatest, plus
from loomgraph.operators.matrix import Matrix, Vector, mask_cells


def _unmasked(t: Matrix | Vector, mask, keys: tuple[str, ...]) -> DataFrame:
    cells = mask_cells(mask, t.df.select(*keys).distinct() if mask is not None else t.df, keys)
    return t.df if cells is None else t.df.join(cells, list(keys), "left_anti")


def to_vector(m: Matrix, monoid: Monoid | None = None, mask=None) -> Vector:
    """One value for each column; mask names rows that don't count. The default is the maximum that starts at 0."""
    monoid = monoid or (DEFAULT_MAX if m.dtype == "double" else greatest(m.dtype, 0))
    df = _unmasked(m, mask, ("i",)).groupBy("j").agg(monoid.aggregate(F.col("v"), F.col("i")).alias("v"))
    return Vector(df.select(F.col("j").alias("i"), "v"), m.ncols, "sparse", monoid.zero).dense()


def to_scalar(t: Matrix | Vector, monoid: Monoid | None = None, mask=None) -> DataFrame:
    """One row, v: all stored values; the default is their sum."""
    monoid = monoid or plus(t.dtype)
    return _unmasked(t, mask, t.keys).agg(monoid.aggregate(F.col("v"), *(F.col(k) for k in t.keys)).alias("v"))


def row_sums(m: Matrix) -> Vector:
    return Vector(m.df.groupBy("i").agg(F.sum("v").cast(m.dtype).alias("v")), m.nrows)


def row_largest(m: Matrix) -> Vector:
    return Vector(m.df.groupBy("i").agg(F.max("v").alias("v")), m.nrows)


def row_argmax(m: Matrix) -> DataFrame:
    """i, j: the column of each row's largest value; of equal ones the lowest."""
    return m.df.groupBy("i").agg(F.max_by("j", F.struct(F.col("v"), -F.col("j"))).alias("j"))


def dot(x: Vector, y: Vector) -> DataFrame:
    return x.df.join(y.df.withColumnRenamed("v", "w"), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("v"))


def change(a: Matrix | Vector, b: Matrix | Vector) -> tuple[float, float]:
    """Sum and largest of the cells' absolute differences."""
    row = a.df.join(b.df.withColumnRenamed("v", "w"), list(a.keys), "full").select(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))).alias("d")).agg(F.sum("d"), F.max("d")).first()
    return row[0] or 0.0, row[1] or 0.0
