"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def connected_components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``; label is the smallest node of its component.

    Alternating large-star and small-star contraction: every round joins and groups on nodes and
    only keeps minima, so no neighbourhood is ever gathered, and the number of rounds grows with
    the logarithm of the graph. Each round is written to the shared folder, which cuts the lineage.
    Self-loops and repeated edges are allowed; an empty table gives no rows.
    """
    now = materialize(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges")
    nodes = now.select("u").union(now.select("v")).distinct()
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("label"))
