"""Matrices, vectors and masks as coordinate tables, with their accessors.

A matrix is a table (i, j, v), a vector a table (i, v); both know their shape. Sparse layouts leave zeros out, dense ones hold
every cell. ``fill`` is what a missing row reads as (0, or a semiring's identity). Nothing is changed in place.

A mask names cells that are NOT written: it is a table of cells, a Matrix or Vector (true where v > 0), or a function of the
key columns; None masks nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ops import is_zero, zero_of


class _Table:
    keys: tuple[str, ...]

    @property
    def dtype(self) -> str:
        return dict(self.df.dtypes)["v"]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def sparse(self):
        """Without zeros."""
        return replace(self, df=self.df.where(~is_zero(F.col("v"), self.dtype)), layout="sparse", fill=0)

    def _settled(self, df: DataFrame):
        """A new object with these rows, zeros left out where the layout does."""
        out = replace(self, df=df)
        return replace(out, df=df.where(~is_zero(F.col("v"), out.dtype))) if self.layout == "sparse" and self.fill == 0 else out

    def _cell(self, *at: int) -> Column:
        self._inside(*at)
        where = F.lit(True)
        for k, x in zip(self.keys, at, strict=True):
            where = where & (F.col(k) == x)
        return where

    def get(self, *at: int):
        """One value; a missing one is the fill."""
        row = self.df.where(self._cell(*at)).select("v").first()
        return row[0] if row else self.spark.range(1).select(F.lit(self.fill).cast(self.dtype)).first()[0] if self.dtype != "string" else ""

    def set(self, *at_and_value):
        *at, value = at_and_value
        kept = self.df.where(~self._cell(*at))
        new = self.spark.range(1).select(*(F.lit(x).cast("long").alias(k) for k, x in zip(self.keys, at, strict=True)), F.lit(value).cast(self.dtype).alias("v"))
        return self._settled(kept.unionByName(new))

    def update(self, *at_and_function):
        """Sets a cell to a function of its value (a missing one is the fill)."""
        *at, function = at_and_function
        one = self.spark.range(1).select(*(F.lit(x).cast("long").alias(k) for k, x in zip(self.keys, at, strict=True)))
        old = one.join(self.df.where(self._cell(*at)), list(self.keys), "left").withColumn("v", function(F.coalesce("v", F.lit(self.fill).cast(self.dtype))).cast(self.dtype))
        return self._settled(self.df.where(~self._cell(*at)).unionByName(old))

    def map(self, function: Callable[..., Column]):
        """function(keys..., v) of every stored value."""
        return self._settled(self.df.withColumn("v", function(*(F.col(k) for k in self.keys), F.col("v"))))

    def stored(self) -> int:
        """Number of stored values (dense: all cells)."""
        return self.df.count()

    def clear(self):
        return replace(self, df=self.df.withColumn("v", zero_of(self.dtype)) if self.layout == "dense" else self.df.limit(0))

    def copy(self):
        return replace(self)

    def entries(self, by_column: bool = False) -> DataFrame:
        """All stored values in row-major order, or column-major."""
        return self.df.orderBy(*(reversed(self.keys) if by_column else self.keys))


@dataclass(frozen=True)
class Matrix(_Table):
    df: DataFrame
    nrows: int
    ncols: int
    layout: str = "sparse"
    fill: object = 0
    keys = ("i", "j")

    def _inside(self, i: int, j: int) -> None:
        if not (0 <= i < self.nrows and 0 <= j < self.ncols):
            raise IndexError(f"({i}, {j}) is outside of {self.nrows} x {self.ncols}")

    @property
    def shape(self) -> tuple[int, int]:
        return self.nrows, self.ncols

    def row(self, i: int) -> "Vector":
        self._inside(i, 0)
        return Vector(self.df.where(F.col("i") == i).select(F.col("j").alias("i"), "v"), self.ncols, self.layout, self.fill)

    def column(self, j: int) -> "Vector":
        self._inside(0, j)
        return Vector(self.df.where(F.col("j") == j).select("i", "v"), self.nrows, self.layout, self.fill)

    def row_array(self, i: int) -> DataFrame:
        """One row as an array, missing values filled in."""
        return self.row(i).array()

    def dense(self) -> "Matrix":
        cells = self.spark.range(self.nrows).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(max(self.ncols - 1, 0))).cast("array<long>")))
        df = cells.join(self.df, ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(self.fill).cast(self.dtype)))
        return replace(self, df=df, layout="dense", fill=0)

    def raw(self) -> list[list]:
        """All cells on the driver; for small matrices."""
        out = [[{"string": "", "boolean": False}.get(self.dtype, self.fill)] * self.ncols for _ in range(self.nrows)]
        for r in self.df.collect():
            out[r["i"]][r["j"]] = r["v"]
        return out

    def transpose(self, mask=None, out: "Matrix | None" = None) -> "Matrix":
        """The mask is tested where a value stands before."""
        cells = mask_cells(mask, self.df, self.keys)
        kept = self.df if cells is None else self.df.join(cells, ["i", "j"], "left_anti")
        df = kept.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        made = replace(self, df=df, nrows=self.ncols, ncols=self.nrows)
        if out is None or cells is None:
            return made
        return replace(made, df=df.unionByName(out.df.join(df.select("i", "j"), ["i", "j"], "left_anti")))

    def by_row(self) -> "Matrix":
        """Rows together: what compressed rows are for."""
        return replace(self.sparse(), df=self.sparse().df.repartition("i").sortWithinPartitions("i", "j"))

    def by_column(self) -> "Matrix":
        return replace(self.sparse(), df=self.sparse().df.repartition("j").sortWithinPartitions("j", "i"))

    def transpose_to_rows(self) -> "Matrix":
        return self.transpose().by_row()

    def transpose_to_columns(self) -> "Matrix":
        return self.transpose().by_column()


@dataclass(frozen=True)
class Vector(_Table):
    df: DataFrame
    n: int
    layout: str = "sparse"
    fill: object = 0
    keys = ("i",)

    def _inside(self, i: int) -> None:
        if not 0 <= i < self.n:
            raise IndexError(f"{i} is outside of {self.n}")

    @property
    def shape(self) -> tuple[int, int]:
        return self.n, 1

    def dense(self) -> "Vector":
        df = self.spark.range(self.n).select(F.col("id").alias("i")).join(self.df, "i", "left").withColumn("v", F.coalesce("v", F.lit(self.fill).cast(self.dtype)))
        return replace(self, df=df, layout="dense", fill=0)

    def array(self) -> DataFrame:
        """One row: values, the vector as an array. For vectors that fit in a row."""
        rows = F.array_sort(F.collect_list(F.struct("i", "v")))
        return self.dense().df.agg(F.transform(rows, lambda x: x["v"]).alias("values"))

    def raw(self) -> list:
        return self.array().first()[0]

    def resize(self, n: int) -> "Vector":
        """The first n values; new ones are zero."""
        out = replace(self, df=self.df.where(F.col("i") < n), n=n)
        return out.dense() if self.layout == "dense" else out

    def matrix(self) -> Matrix:
        return Matrix(self.df.select("i", F.lit(0).cast("long").alias("j"), "v"), self.n, 1, self.layout, self.fill)


def mask_cells(mask, over: DataFrame, keys: tuple[str, ...]) -> DataFrame | None:
    """The masked cells, or None. A function of the key columns is evaluated on the cells of over."""
    if mask is None:
        return None
    if isinstance(mask, (Matrix, Vector)):
        mask = mask.df.where(F.col("v") > 0)
    elif callable(mask):
        mask = over.where(mask(*(F.col(k) for k in keys)))
    return mask.select(*keys).distinct()


def written_with(result, mask, out):
    """result where it isn't masked, and what out holds where it is."""
    cells = mask_cells(mask, result.df if out is None else result.df.select(*result.keys).unionByName(out.df.select(*result.keys)), result.keys)
    if cells is None:
        return result
    keys = list(result.keys)
    df = result.df.join(cells, keys, "left_anti")
    if out is not None:
        df = df.unionByName(out.df.join(cells, keys, "left_semi").withColumn("v", F.col("v").cast(result.dtype)))
    return replace(result, df=df)
