"""Connected components of a graph of links, by contraction; no link or component comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame | None:
    """node, comp (the smallest node of the component) for every node of links (a, b); None if there is no link.

    Each round hooks every node to its smallest neighbour, follows that
    neighbour's own hook once, and contracts; a star or a clique is done after
    one or two rounds, a path after about log(length).
    """
    edges = checkpoint(links.select("a", "b").where("a <> b").distinct())
    whole = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        hook = checkpoint(hook.join(hook.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p").select("a", F.col("pp").alias("p")))
        whole = hook.select(F.col("a").alias("node"), F.col("p").alias("comp")) if whole is None else whole.join(hook, F.col("comp") == F.col("a"), "left").select("node", F.coalesce("p", "comp").alias("comp"))
        left = hook.select("a", F.col("p").alias("pa"))
        right = hook.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = checkpoint(edges.join(left, "a").join(right, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct())
    return whole if whole is None else checkpoint(whole)
