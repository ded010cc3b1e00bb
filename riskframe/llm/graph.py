"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import cut, drop_cut


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Component of every node of ``edges`` (columns a, b): returns (node, root).

    ``root`` is the smallest node of the component.  Every round hooks each node to its
    smallest neighbour (a map-side combined minimum, so a hub costs one row per task),
    follows the hooks to their ends by repeated doubling, and contracts the edges to
    the ends.  Only nodes smaller than all their neighbours are left after a round, each with
    those that hooked to it; the largest node with an edge always goes, but how many go depends
    on the numbers (of a star with the largest number in its middle, one).  Self loops, repeated
    edges and nulls are ignored; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    live = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
               .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
               .distinct(), f"{tag}-edges")
    label = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
                   .select("node", F.least("node", "up").alias("up")), f"{tag}-hook")
        while True:
            nxt = hook.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            jumped = cut(hook.join(nxt, "up").select("node", F.col("up2").alias("up"),
                                                     (F.col("up") != F.col("up2")).alias("moved")),
                         f"{tag}-jump")
            still = not jumped.where("moved").isEmpty()
            drop_cut(hook)
            hook = jumped.drop("moved")
            if not still:
                break
        ends_a = hook.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        ends_b = hook.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        contracted = cut(live.join(ends_a, "a").join(ends_b, "b").where("ra <> rb")
                         .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                         .distinct(), f"{tag}-edges")
        drop_cut(live)
        live = contracted
        if label is None:
            label = hook.select("node", F.col("up").alias("root"))
        else:
            moved = hook.select(F.col("node").alias("root"), F.col("up").alias("r2"))
            newer = cut(label.join(moved, "root", "left")
                        .select("node", F.coalesce("r2", "root").alias("root")), f"{tag}-label")
            drop_cut(label)
            drop_cut(hook)
            label = newer
    if label is None:
        return spark.createDataFrame([], "node long, root long")
    return label
