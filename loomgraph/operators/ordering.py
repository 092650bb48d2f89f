"""Positions and running sums in a total order without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.sources.storage import cut


def numbered(df: DataFrame, *order: str, name: str) -> DataFrame:
    """df with each row's position from 0. Rows are dealt by ranges of the order; only the ranges' sizes come to the driver."""
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in parts.groupBy("__part").count().orderBy("__part").collect():
        offsets.append((r["__part"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "__part int, __before long")
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1 + F.col("__before")
    return parts.join(F.broadcast(starts), "__part").withColumn(name, place.cast("long")).drop("__part", "__before")


def running(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """df with each of columns summed up from the first row to each one, in order (without ties). Only the ranges' sums come to the driver."""
    parts = cut(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    before, offsets = [0.0] * len(columns), []
    for r in parts.groupBy("__part").agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in columns)).orderBy("__part").collect():
        offsets.append((r["__part"], *before))
        before = [b + r[c] for b, c in zip(before, columns)]
    starts = df.sparkSession.createDataFrame(offsets, ", ".join(["__part int", *(f"__before{k} double" for k in range(len(columns)))]))
    own = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = parts.join(F.broadcast(starts), "__part")
    return out.select(*(c for c in df.columns if c not in columns), *((F.sum(c).over(own) + F.col(f"__before{k}")).alias(c) for k, c in enumerate(columns)))
