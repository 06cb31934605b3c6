"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round joins on nodes and never gathers a component in one place; a hot node's neighbours are split by the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (in small rounds only the smaller ones) are linked to the least of them and the node."""
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    around = ordered.unionByName(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))) if large else ordered
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = around.join(least, "u")
    out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node with an edge; ``edges`` has columns a and b."""
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        edges = cut(_stars(_stars(edges, True), False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
