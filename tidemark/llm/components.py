"""Connected components of a link table, by alternating large and small stars.

Each round takes, for every node, the least of its neighbours by a partial
aggregate and joins it back; no node's neighbours are gathered in a task, and a
node with very many links is a skewed join that the adaptive planner divides.
Lineage is cut with checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import cut


def _large(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours linked to its least one."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node it reaches.

    ``links``: columns a and b of one orderable type; direction, repeats and
    links of a node to itself don't matter. Rounds go on until nothing changes.
    """
    a, b = links.columns
    now = cut(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    state = None
    while True:
        now = cut(_small(_large(now).distinct()))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    # all links are stars now: from a node to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
