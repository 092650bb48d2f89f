"""Reduced row echelon form over a table of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators.matrix import Matrix
from loomgraph.sources.storage import cut, drop


def reduced(m: Matrix) -> Matrix:
    """Gauss-Jordan with the first row that has a non-zero as pivot. One pass over the rows for each pivot, so for matrices with few rows or columns."""
    filled = m.dense().df.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"].cast("double")).alias("row"))
    rows = cut(filled)
    lead = 0
    for r in range(m.nrows):
        found = None
        while lead < m.ncols:
            found = rows.where((F.col("i") >= r) & (F.col("row")[lead] != 0)).orderBy("i").first()
            if found:
                break
            lead += 1
        if not found:
            break
        i, pivot = found["i"], [x / found["row"][lead] for x in found["row"]]
        p = F.array(*(F.lit(float(x)) for x in pivot))
        place = F.when(F.col("i") == r, i).when(F.col("i") == i, r).otherwise(F.col("i")).cast("long")
        at = lead
        cleared = F.zip_with("row", p, lambda x, y: x - F.col("row")[at] * y)
        fresh = cut(rows.withColumn("i", place).withColumn("row", F.when(F.col("i") == r, p).otherwise(cleared)))
        drop(rows)
        rows, lead = fresh, lead + 1
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")
    return Matrix(cells, m.nrows, m.ncols, "dense")
