"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.session import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _towards_least(pairs: DataFrame, own: bool) -> DataFrame:
    """Every neighbour of ``a`` linked to the least of ``a`` and its neighbours; a hot node is only a skewed join key."""
    least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = pairs.join(least, "a")
    links = joined.where("b > a").select(F.col("b").alias("b"), F.col("m").alias("a")) if not own else joined.select("b", F.col("m").alias("a"))
    if own:
        links = links.unionByName(least.select(F.col("a").alias("b"), F.col("m").alias("a")))
    return links.where("a <> b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the least node reachable.

    Large-star and small-star alternate until every node hangs on its root, in about log^2 rounds, each cut by a
    checkpoint. Loops and repeated edges do no harm; an empty table gives an empty one.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    mark = None
    while True:
        large = _towards_least(_both(edges), own=False)
        small = cut_lineage(_towards_least(large.select(F.col("b").alias("a"), F.col("a").alias("b")), own=True))
        now = small.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        edges = small
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
