"""Connected components of a graph of links, by alternating large and small stars.

Each round joins the links with the smallest neighbour of every node; a node
with very many links only adds a row to a partial minimum and rows to a join
of two plain shuffles, which may be split. Rounds grow with the logarithm of the longest path, and each
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a > b. Large: what lies above a node joins its smallest neighbour; small: what lies below does."""
    down = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    seen = down.union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else down
    least = stored(seen.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("w"), F.least("u", "v").alias("m")), "least")
    joined = seen.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that is reachable."""
    links = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "links"
    )
    was = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b") % 1000003).alias("s")).first()
        if now == was or not now["n"]:
            break
        was = now
        links = stored(_star(_star(links, large=True), large=False), "links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
