"""Connected components of a table of links, as repeated joins and group-bys.

Rounds of large-star and small-star (Kiveris et al., 2014) turn the links into stars around the smallest node of
each component. A round takes the smallest neighbour by a group-by, which combines before its shuffle, and joins
it back to the links, so a node with very many links is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import drop_stored, stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself included)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them. Links come as a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links(a, b)``: root is the smallest node that it reaches. Null ends and loops are dropped."""
    ordered = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(ordered, "links")
    mark = _mark(now)
    while mark[0]:
        new = stored(_small_star(_large_star(now)), "links")
        seen = _mark(new)
        drop_stored(now)
        now = new
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def local_roots(n: int, pairs) -> "object":
    """Smallest reachable index for each of ``n`` nodes; ``pairs`` yields arrays (a, b) of links. Small helper inside tasks."""
    import numpy as np

    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return root
