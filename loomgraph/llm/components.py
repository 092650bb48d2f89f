"""Connected components of a table of links, by label propagation with pointer jumping; all state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node reachable, for every node of links. Nulls link nothing; an empty table gives no rows.

    Each round takes the least label among a node and its neighbours, then that label's own label, so that the rounds
    grow with the logarithm of the longest path. A label is carried by at most one row for each node and task."""
    pairs = links.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    state = written(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("label")), "labels")
    while True:
        near = both.join(state.select(F.col("node").alias("v"), F.col("label").alias("seen")), "v").groupBy("u").agg(F.min("seen").alias("seen"))
        best = state.join(near.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "seen").alias("next"))
        jump = state.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        # what a label's own node had: a label of at most the same size, so the step never goes up
        fresh = written(best.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("label"), (F.least("next", F.coalesce("beyond", "next")) < F.col("label")).alias("moved")), "labels")
        dropped(state)
        state = fresh.select("node", "label")
        state._written_at = fresh._written_at
        if fresh.where("moved").limit(1).count() == 0:
            dropped(both)
            return state
