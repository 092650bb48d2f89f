"""Operators cell by cell."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from loomgraph.functions.ops import BinaryOp, UnaryOp, minimum, zero_of
from loomgraph.operators.matrix import Matrix, Vector, written_with

Table = Matrix | Vector


def _same(a: Table, b: Table) -> None:
    if a.shape != b.shape:
        raise ValueError(f"shapes {a.shape} and {b.shape} differ")


def apply(a: Table, function: UnaryOp, mask=None, out: Table | None = None) -> Table:
    """function of every stored value that isn't masked."""
    return written_with(a._settled(a.df.withColumn("v", function(F.col("v")))), mask, out)


def assign(a: Table, value, mask=None) -> Table:
    """value in every cell that isn't masked; masked cells keep theirs."""
    full = a.dense()
    return written_with(full._settled(full.df.withColumn("v", F.lit(value).cast(a.dtype))), mask, full)


def scale(a: Table, factor) -> Table:
    return a._settled(a.df.withColumn("v", (F.col("v") * F.lit(factor)).cast(a.dtype)))


def negative(a: Table, mask=None, out: Table | None = None) -> Table:
    return written_with(a._settled(a.df.withColumn("v", -F.col("v"))), mask, out)


def transpose(a: Matrix, mask=None, out: Matrix | None = None) -> Matrix:
    return a.transpose(mask, out)


def add(a: Table, b: Table, mask=None, out: Table | None = None) -> Table:
    """The sum of all cells of both."""
    _same(a, b)
    df = a.df.unionByName(b.df).groupBy(*a.keys).agg(F.sum("v").cast(a.dtype).alias("v"))
    layout = "dense" if "dense" in (a.layout, b.layout) else "sparse"
    return written_with(replace(a, layout=layout)._settled(df), mask, out)


def subtract(a: Table, b: Table, mask=None, out: Table | None = None) -> Table:
    return add(a, replace(b, df=b.df.withColumn("v", -F.col("v"))), mask, out)


def ewise_mult(a: Table, b: Table, mask=None, out: Table | None = None, op: BinaryOp | None = None) -> Table:
    """Values that are equal in both; with op, op of both values where both are stored."""
    _same(a, b)
    keys = list(a.keys)
    joined = a.df.join(b.df.withColumnRenamed("v", "w"), keys)
    df = joined.where(F.col("v") == F.col("w")).select(*keys, "v") if op is None else joined.select(*keys, op(F.col("v"), F.col("w")).alias("v"))
    return written_with(replace(a, layout="sparse", fill=0)._settled(df), mask, out)


def ewise_add(a: Table, b: Table, mask=None, out: Table | None = None, op: BinaryOp | None = None) -> Table:
    """The non-zeros of a overlaid by those of b; with op, op of both where both are stored."""
    _same(a, b)
    keys = list(a.keys)
    joined = a.df.join(b.df.withColumnRenamed("v", "w"), keys, "full")
    if op is None:
        none = zero_of(a.dtype)
        value = F.coalesce(F.nullif(F.col("w"), none), F.nullif(F.col("v"), none), none)
    else:
        value = F.when(F.col("v").isNull(), F.col("w")).when(F.col("w").isNull(), F.col("v")).otherwise(op(F.col("v"), F.col("w")))
    layout = "dense" if "dense" in (a.layout, b.layout) else "sparse"
    return written_with(replace(a, layout=layout)._settled(joined.select(*keys, value.alias("v"))), mask, out)


def least(a: Table, b: Table) -> Table:
    """The smaller value of each cell, fills included."""
    _same(a, b)
    keys, fill = list(a.keys), lambda t: F.lit(t.fill).cast(t.dtype)
    joined = a.df.join(b.df.withColumnRenamed("v", "w"), keys, "full")
    df = joined.select(*keys, minimum(F.coalesce("v", fill(a)), F.coalesce("w", fill(b))).alias("v"))
    layout = "dense" if "dense" in (a.layout, b.layout) else "sparse"
    return replace(a, layout=layout, fill=min(a.fill, b.fill))._settled(df)


def differences(a: Table, b: Table):
    """Cells whose values differ, a missing one being the fill."""
    keys = list(a.keys)
    joined = a.df.join(b.df.withColumnRenamed("v", "w"), keys, "full")
    left, right = F.coalesce("v", _fill(a)), F.coalesce("w", _fill(b))
    return joined.where(left != right).select(*keys, left.alias("left"), right.alias("right"))


def _fill(t: Table):
    return zero_of(t.dtype) if t.fill == 0 else F.lit(t.fill).cast(t.dtype)


def equal(a: Table, b: Table) -> bool:
    return a.shape == b.shape and differences(a, b).limit(1).count() == 0


def not_equal(a: Table, b: Table) -> bool:
    return not equal(a, b)


def symmetric(m: Matrix) -> bool:
    return m.nrows == m.ncols and equal(m, m.transpose())


def skew_symmetric(m: Matrix) -> bool:
    return m.nrows == m.ncols and equal(m, negative(m.transpose()))
