"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenota.session import checkpointed


def _star(edges: DataFrame, at: str, other: str, keep: Column) -> DataFrame:
    """Hang the neighbours that ``keep`` names on the least node around ``at``; the least node is
    joined back to the edges, so no neighbourhood meets in one row."""
    least = edges.groupBy(F.col(at).alias("__at")).agg(F.min(other).alias("__m"))
    least = least.withColumn("__m", F.least("__m", "__at"))
    hung = edges.join(least, F.col(at) == F.col("__at"))
    return hung.where(keep).select(F.col(other).alias("a"), F.col("__m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); a component is its least node.

    Each round hangs all larger neighbours of a node on its least neighbour (large star), then each
    node and its smaller neighbours on the least of them (small star), until nothing changes. Edges
    never grow in number; each round is cut from its lineage in the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = checkpointed(edges.where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, "a", "b", F.col("b") > F.col("a")).where("a <> b").distinct()
        # small star: edges point from the larger node to the smaller
        least = large.groupBy(F.col("a").alias("__at")).agg(F.min("b").alias("__m"))
        hung = large.join(least, F.col("a") == F.col("__at"))
        again = hung.select(F.col("b").alias("a"), F.col("__m").alias("b"))
        own = least.select(F.col("__at").alias("a"), F.col("__m").alias("b"))
        edges = checkpointed(again.union(own).where("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        state = tuple(state.first())
        if state == before:
            break
        before = state
    top = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(top)
