"""Connected components of links by alternating stars, in a number of rounds that grows with the logarithm of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.operators.staging_area import staged


def _stars(links: DataFrame) -> DataFrame:
    """One round on ``links(a, b)``, a > b: every larger neighbour is tied to the smallest, then every node and its
    smaller neighbours to the smallest of them. Smallest ones are found map-side first, so a hub is one row per task."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    tied = large.join(low, "a")
    small = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
    return small.where("a != b").distinct()


def closed_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, label)`` of ``nodes``: the smallest node of each connected component of ``edges(a, b)``.

    Large and small stars alternate until the links no longer change; each round is written out, so it survives lost
    executors and its plan stays short. A count and a checksum of the links are all that reaches the driver.
    """
    links = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == mark or not now[0]:
            break
        links, mark = staged(_stars(links), "links"), now
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
