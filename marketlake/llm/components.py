"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.session import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes. Each step is a partial
    minimum per node and a join on the node, which the adaptive join splits where a node has many
    neighbours; no list of neighbours is built. Every round is written to the shared folder, so
    the plan stays short and lost executors cost one round. Loops are ignored; an empty table
    gives no rows.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = staged(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(moved.union(least).distinct(), "edges")
        after = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    return edges.union(edges.select("b", "b").distinct()).toDF("node", "root")
