"""Connected components of links too many for one machine, by contraction.

Every round hooks each node to its smallest smaller neighbour, follows the hooks to the end and
replaces nodes by what they hang on. Nodes that hang on nothing are at most half of those with
links, so the rounds grow with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link; root is the smallest node reachable.

    Links are undirected and may repeat; loops and links with a null end are left out.
    """
    edges = cut_lineage(
        links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct()
    )
    labels = None
    while not edges.isEmpty():
        parents = _to_the_end(cut_lineage(edges.groupBy("hi").agg(F.min("lo").alias("lo"))))
        if labels is None:
            labels = parents.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        else:
            moved = parents.select(F.col("hi").alias("root"), F.col("lo").alias("next"))
            labels = cut_lineage(
                labels.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
                .unionByName(parents.select(F.col("hi").alias("node"), F.col("lo").alias("root")))
            )
        edges = cut_lineage(_contracted(edges, parents))
    if labels is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    roots = labels.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return labels.unionByName(roots)


def _to_the_end(parents: DataFrame) -> DataFrame:
    """Follow each node's parent to a node without one, doubling the distance each time."""
    while True:
        above = parents.select(F.col("hi").alias("lo"), F.col("lo").alias("next"))
        jumped = cut_lineage(parents.join(above, "lo", "left").select("hi", F.coalesce("next", "lo").alias("lo"), F.col("next").isNotNull().alias("moved")))
        parents = jumped.select("hi", "lo")
        if jumped.where("moved").isEmpty():
            return parents


def _contracted(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """The links between what the two ends hang on."""
    low = parents.select(F.col("hi").alias("lo"), F.col("lo").alias("low"))
    high = parents.select("hi", F.col("lo").alias("high"))
    ends = edges.join(high, "hi").join(low, "lo", "left").select("high", F.coalesce("low", "lo").alias("low"))
    return ends.where("high != low").select(F.greatest("high", "low").alias("hi"), F.least("high", "low").alias("lo")).distinct()
