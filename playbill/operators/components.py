"""Connected components in rounds that grow with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playbill.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches.

    Every round turns an edge towards the least neighbour of its larger end, once among all
    neighbours and once among the smaller ones; the distance to the root halves, and there are
    never more edges than at the start.  A round is written out, and it is the last one when every
    edge already ends at a root.
    """
    stars = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    while True:
        both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        nearest = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
        # Larger neighbours go to the least node around.
        upper = both.join(nearest, "node").filter("root > node").select(F.col("root").alias("node"), F.col("low").alias("root")).filter("node <> root").distinct()
        # Smaller neighbours go to the least of them, as the node itself does.
        least = upper.groupBy("node").agg(F.min("root").alias("low"))
        lower = upper.join(least, "node").filter("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        stars = cut(lower.unionByName(least.select("node", F.col("low").alias("root"))).distinct())
        inner = stars.select(F.col("root").alias("node")).join(stars.select("node"), "node", "left_semi")
        several = stars.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        if inner.isEmpty() and several.isEmpty():
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
