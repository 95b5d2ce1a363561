"""Connected components by hooking and contraction, as joins and aggregations over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges (u, v bigint): comp is the smallest node of its component.

    Each round points every node at its smallest neighbour (an aggregation with partial minima, so a hub costs no
    more than other nodes), follows the pointers once, and contracts the edges to the pointed-at nodes; edges
    inside a contracted node go. The rounds end when no edge is left. Every round's tables are written to the
    shared folder."""
    e = stored(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    labels = stored(e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct().withColumn("comp", F.col("node")), "cc-labels")
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = stored(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "cc-hook")
        jump = stored(hook.alias("a").join(hook.alias("b"), F.col("a.p") == F.col("b.u")).select("a.u", "b.p"), "cc-jump")
        to = lambda df, key: df.join(jump.select(F.col("u").alias("_u"), F.col("p").alias("_p")), F.col(key) == F.col("_u"), "left")
        labels = stored(to(labels, "comp").select("node", F.coalesce("_p", "comp").alias("comp")), "cc-labels")
        moved = to(to(e, "u").select(F.coalesce("_p", "u").alias("u"), "v"), "v").select("u", F.coalesce("_p", "v").alias("v"))
        e = stored(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    # nodes merge towards smaller ones, so a component's last node is its smallest
    return labels
