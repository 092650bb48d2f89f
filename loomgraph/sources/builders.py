"""Matrices and vectors from edges, arrays and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ops import FLOATS
from loomgraph.operators.matrix import Matrix, Vector


def from_edges(edges: DataFrame, nrows: int, ncols: int, source: str = "from", target: str = "to", weight: str = "weight", check: bool = True) -> Matrix:
    """Weights of the same cell add up; zero weights and zero sums are left out. Ends outside of the shape raise IndexError."""
    rows = edges.select(F.col(source).cast("long").alias("i"), F.col(target).cast("long").alias("j"), F.col(weight).alias("v"))
    if check:
        lo_i, hi_i, lo_j, hi_j = rows.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
        if lo_i is not None and (min(lo_i, lo_j) < 0 or hi_i >= nrows or hi_j >= ncols):
            raise IndexError(f"an edge is outside of {nrows} x {ncols}")
    kind = dict(rows.dtypes)["v"]
    total = rows.where(F.col("v") != 0).groupBy("i", "j").agg(F.sum("v").cast(kind).alias("v")).where(F.col("v") != 0)
    return Matrix(total, nrows, ncols)


def _kind(values: list, dtype: str) -> list:
    return [float(x) for x in values] if dtype in FLOATS else list(values)


def from_array(spark: SparkSession, values: list[list], dtype: str = "double", layout: str = "sparse") -> Matrix:
    """A matrix from rows of values."""
    nrows, ncols = len(values), len(values[0]) if values else 0
    if any(len(r) != ncols for r in values):
        raise ValueError("rows differ in length")
    df = spark.createDataFrame([(i, _kind(r, dtype)) for i, r in enumerate(values)], f"i long, r array<{dtype}>")
    cells = df.select("i", F.posexplode("r").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")
    out = Matrix(cells, nrows, ncols, "dense")
    return out if layout == "dense" else out.sparse()


def vector_from_array(spark: SparkSession, values: list, dtype: str = "double", layout: str = "sparse") -> Vector:
    df = spark.createDataFrame([(_kind(values, dtype),)], f"r array<{dtype}>").select(F.posexplode("r").alias("i", "v")).select(F.col("i").cast("long").alias("i"), "v")
    out = Vector(df, len(values), "dense")
    return out if layout == "dense" else out.sparse()


def empty(spark: SparkSession, nrows: int, ncols: int, dtype: str = "double") -> Matrix:
    return Matrix(spark.createDataFrame([], f"i long, j long, v {dtype}"), nrows, ncols)


def empty_vector(spark: SparkSession, n: int, dtype: str = "double") -> Vector:
    return Vector(spark.createDataFrame([], f"i long, v {dtype}"), n)


def zeros(spark: SparkSession, nrows: int, ncols: int, dtype: str = "double") -> Matrix:
    return empty(spark, nrows, ncols, dtype).dense()


def zero_vector(spark: SparkSession, n: int, dtype: str = "double") -> Vector:
    return empty_vector(spark, n, dtype).dense()


def from_parquet(spark: SparkSession, path: str, nrows: int, ncols: int, source: str, target: str, weight: str) -> Matrix:
    """Edges from a Parquet file or folder; only the three columns are read."""
    return from_edges(spark.read.parquet(path).select(source, target, weight), nrows, ncols, source, target, weight)


def to_parquet(m: Matrix | Vector, path: str, mode: str = "errorifexists") -> None:
    m.df.write.mode(mode).parquet(path)
