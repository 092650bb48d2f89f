"""A stream of edges folded into a stored matrix, with the builder's rule that weights of one cell add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.matrix import Matrix


def fold(edges: DataFrame, path: str, checkpoint: str, source: str = "from", target: str = "to", weight: str = "weight") -> StreamingQuery:
    """Writes each batch's sums under path/batch=<id>; a batch that is run again overwrites itself, so each edge counts once."""

    def batch(df: DataFrame, number: int) -> None:
        sums = df.groupBy(F.col(source).cast("long").alias("i"), F.col(target).cast("long").alias("j")).agg(F.sum(weight).alias("v"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark, path: str, nrows: int, ncols: int) -> Matrix:
    """The matrix of all batches so far."""
    df = spark.read.parquet(path).groupBy("i", "j").agg(F.sum("v").alias("v")).where(F.col("v") != 0)
    return Matrix(df, nrows, ncols)
