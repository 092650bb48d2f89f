"""Products: an equi-join on the inner index, then one aggregate. That of two matrices is made block by block of the rows of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.algebra import Semiring, plus_times
from loomgraph.operators.matrix import Matrix, Vector, mask_cells, written_with
from loomgraph.sources.storage import cut

#: Halvings of one Strassen product: seven products each.
LEVELS = 2


def _shapes(a: tuple[int, int], b: tuple[int, int]) -> None:
    if a[1] != b[0]:
        raise ValueError(f"shapes {a} and {b} don't fit")


def mxm(a: Matrix, b: Matrix, mask=None, out: Matrix | None = None, semiring: Semiring | None = None) -> Matrix:
    """A·B. Masked cells are dropped before the sums are made; they keep out's values."""
    plain = semiring is None
    ring = semiring or plus_times(a.dtype)
    products = _products(a, b, ring)
    cells = mask_cells(mask, products.select("i", "j") if callable(mask) and not isinstance(mask, (Matrix, Vector)) else products, ("i", "j"))
    if cells is not None:
        products = products.join(cells, ["i", "j"], "left_anti")
    df = _summed(products, ring, plain, a.dtype).select("i", "j", "v")
    made = Matrix(df, a.nrows, b.ncols, "sparse", 0 if plain else ring.zero)
    return made if cells is None else written_with(made, cells, out)


def mxm_blocks(a: Matrix, b: Matrix) -> DataFrame:
    """A·B as block, i, j, v: a row's cells are of one block, and a block's in one task."""
    ring = plus_times(a.dtype)
    return _summed(_products(a, b, ring), ring, True, a.dtype)


def _summed(products: DataFrame, ring: Semiring, plain: bool, dtype: str) -> DataFrame:
    df = products.groupBy("block", "i", "j").agg(ring.add.aggregate(F.col("p"), F.col("k")).alias("v"))
    return df.withColumn("v", F.col("v").cast(dtype)).where(F.col("v") != 0) if plain else df


def _products(a: Matrix, b: Matrix, ring: Semiring) -> DataFrame:
    """block, i, j, k, p: products where they are summed, so that no product is shuffled.

    Rows of A go in blocks, as many as there are shuffle partitions. A block gets, for each inner index that it has, its own cells and
    that row of B, both as arrays: a row of B goes to a block once, however many rows of the block it meets."""
    _shapes(a.shape, b.shape)
    parts = int(a.spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, -(-a.nrows // parts))
    left = a.df.select(F.floor(F.col("i") / size).alias("block"), F.col("j").alias("k"), F.struct("i", F.col("v").alias("x")).alias("one"))
    left = left.repartition("k").groupBy("k", "block").agg(F.collect_list("one").alias("xs"))
    right = b.df.select(F.col("i").alias("k"), F.struct("j", F.col("v").alias("y")).alias("one")).groupBy("k").agg(F.collect_list("one").alias("ys"))
    met = left.join(right, "k").repartition(parts, "block")
    each = met.select("block", "k", F.explode("xs").alias("x"), "ys").select("block", "k", F.col("x.i").alias("i"), F.col("x.x").alias("x"), F.explode("ys").alias("y"))
    return each.select("block", "i", F.col("y.j").alias("j"), "k", ring.multiply(F.col("x"), F.col("y.y")).alias("p"))


def mxv(a: Matrix, x: Vector, mask=None, out: Vector | None = None, semiring: Semiring | None = None) -> Vector:
    """A·x. Over a semiring, values of x that aren't stored take part as its fill, and rows without entries read as the identity."""
    _shapes(a.shape, x.shape)
    plain = semiring is None
    ring = semiring or plus_times(a.dtype)
    cells = mask_cells(mask, a.df.select("i").distinct(), ("i",))
    rows = a.df if cells is None else a.df.join(cells, "i", "left_anti")  # masked rows are never multiplied
    right = x.df.select(F.col("i").alias("j"), F.col("v").alias("y"))
    inner = plain or x.layout == "dense" or (ring.annihilates and x.fill == ring.zero)
    joined = rows.join(right, "j", "inner" if inner else "left")
    y = F.col("y") if inner else F.coalesce("y", F.lit(x.fill).cast(x.dtype))
    df = joined.select("i", "j", ring.multiply(F.col("v"), y).alias("p")).groupBy("i").agg(ring.add.aggregate(F.col("p"), F.col("j")).alias("v"))
    if plain:
        df = df.withColumn("v", F.col("v").cast(a.dtype)).where(F.col("v") != 0)
    made = Vector(df, a.nrows, "sparse", 0 if plain else ring.zero)
    return made if cells is None else written_with(made, cells, out)


def vxm(x: Vector, a: Matrix, mask=None, out: Vector | None = None, semiring: Semiring | None = None, transpose: bool = False) -> Vector:
    """A·x as well; with transpose, x as a row times A."""
    return mxv(a.transpose() if transpose else a, x, mask, out, semiring)


#: Strassen's seven products: signed quarters (row, column, sign) of the left and of the right side, and where each product goes.
SEVEN = [
    ([(0, 0, 1), (1, 1, 1)], [(0, 0, 1), (1, 1, 1)], [(0, 0, 1), (1, 1, 1)]),
    ([(1, 0, 1), (1, 1, 1)], [(0, 0, 1)], [(1, 0, 1), (1, 1, -1)]),
    ([(0, 0, 1)], [(0, 1, 1), (1, 1, -1)], [(0, 1, 1), (1, 1, 1)]),
    ([(1, 1, 1)], [(1, 0, 1), (0, 0, -1)], [(0, 0, 1), (1, 0, 1)]),
    ([(0, 0, 1), (0, 1, 1)], [(1, 1, 1)], [(0, 0, -1), (0, 1, 1)]),
    ([(1, 0, 1), (0, 0, -1)], [(0, 0, 1), (0, 1, 1)], [(1, 1, 1)]),
    ([(0, 1, 1), (1, 1, -1)], [(1, 0, 1), (1, 1, 1)], [(0, 0, 1)]),
]


def strassen(a: Matrix, b: Matrix, crossover: int = 64) -> Matrix:
    """A·B by seven products of half the size where all sides are above crossover, at most LEVELS times; below it by the plain product.

    All products of a level are one table with their number, so there is one join, however many products; both sides are written once.
    On joins this saves no work (each product has its own quarters), so the plain product is the one to use."""
    _shapes(a.shape, b.shape)
    if crossover < 1:
        raise ValueError("crossover starts at 1")
    halves, sides = [], (*a.shape, b.ncols)
    while len(halves) < LEVELS and min(sides) > crossover:
        halves.append(-(-max(sides) // 2))
        sides = (halves[-1],) * 3
    if not halves:
        return mxm(a, b)
    left = cut(a.df)
    right = left if b.df is a.df else cut(b.df)
    left, right = (x.select(F.lit(0).cast("long").alias("part"), "i", "j", "v") for x in (left, right))
    for half in halves:
        left, right = _halved(left, half, 0), _halved(right, half, 1)
    products = left.select("part", "i", F.col("j").alias("k"), F.col("v").alias("x")).join(right.select("part", F.col("i").alias("k"), "j", F.col("v").alias("y")), ["part", "k"])
    rows = products.groupBy("part", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    for half in reversed(halves):
        rows = _joined(rows, half)
    return Matrix(rows.select("i", "j", F.col("v").cast(a.dtype).alias("v")).where(F.col("v") != 0), a.nrows, b.ncols)


def _halved(rows: DataFrame, half: int, side: int) -> DataFrame:
    """One side of the seven products of each part: the sums of its quarters."""
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    places = F.lit(None).cast("array<struct<number:int,sign:int>>")
    for r in (0, 1):
        for c in (0, 1):
            uses = [(n, sign) for n, seven in enumerate(SEVEN) for row, column, sign in seven[side] if (row, column) == (r, c)]
            places = F.when((i >= half if r else i < half) & (j >= half if c else j < half), F.array(*(F.struct(F.lit(n).alias("number"), F.lit(sign).alias("sign")) for n, sign in uses))).otherwise(places)
    each = rows.select("part", F.when(i >= half, i - half).otherwise(i).alias("i"), F.when(j >= half, j - half).otherwise(j).alias("j"), "v", F.explode(places).alias("at"))
    return each.select((F.col("part") * 7 + F.col("at.number")).alias("part"), "i", "j", (v * F.col("at.sign")).alias("v")).groupBy("part", "i", "j").agg(F.sum("v").alias("v")).where(v != 0)


def _joined(rows: DataFrame, half: int) -> DataFrame:
    """The products of each part put where they go in their matrix."""
    number = F.pmod("part", F.lit(7))
    places = F.lit(None).cast("array<struct<i:bigint,j:bigint,sign:int>>")
    for n, (_, _, goes) in enumerate(SEVEN):
        places = F.when(number == n, F.array(*(F.struct(F.lit(half * r).cast("long").alias("i"), F.lit(half * c).cast("long").alias("j"), F.lit(sign).alias("sign")) for r, c, sign in goes))).otherwise(places)
    each = rows.select(F.floor(F.col("part") / 7).alias("part"), "i", "j", "v", F.explode(places).alias("at"))
    return each.select("part", (F.col("i") + F.col("at.i")).alias("i"), (F.col("j") + F.col("at.j")).alias("j"), (F.col("v") * F.col("at.sign")).alias("v")).groupBy("part", "i", "j").agg(F.sum("v").alias("v"))
