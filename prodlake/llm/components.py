"""Connected components by alternating large-star and small-star steps.

Each step is a map-side minimum per node and a join; no group is collected, so a node with a
third of all edges costs no more than its rows.  Rounds end when the edges no longer change;
every round is cut with a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``edges`` (a, b: bigint); the root is the component's
    smallest node.  Loops and repeated edges do no harm; null ends are left out."""
    stars = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    # u < v throughout; least() skips nulls, so a null end gives a loop
    stars = checkpointed(stars.filter("u < v").distinct())
    state = _state(stars)
    while True:
        # large-star: every larger neighbour of a node moves to the node's smallest neighbour
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
        large = both.filter("v > u").join(least, "u").select(F.col("least").alias("u"), "v").distinct()
        # small-star: the smaller neighbours of a node and itself move to the smallest one
        smallest = large.groupBy("v").agg(F.min("u").alias("least"))
        small = large.join(smallest, "v").select(F.col("least").alias("u"), F.when(F.col("u") == F.col("least"), F.col("v")).otherwise(F.col("u")).alias("v"))
        # the node itself is linked by its smallest edge, which is kept as it is
        stars = checkpointed(small.distinct())
        now = _state(stars)
        if now == state:
            break
        state = now
    nodes = stars.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return nodes.union(stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
