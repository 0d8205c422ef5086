"""Connected components by alternating large and small stars.

Each step is aggregations and joins on node ids, so no component is ever gathered in one task: a
node with very many neighbours is pre-aggregated in its minimum, and the join that hands the minimum
back is a plain equi-join whose skew adaptive execution may split. The number of edges never grows.
Rounds go on until every edge ends at its component's smallest node: their number grows with the
logarithm of the nodes, and a step that changes nothing ends them, so there is no limit to reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.plans.lineage import dropped, kept


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one orderable type, any order, repeats and loops allowed -> (node, root): every
    node of an edge between two different nodes, with the smallest node that it is connected with."""
    e = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("p")).filter("u != p").distinct())
    while True:
        e, old = kept(_small_star(_large_star(e))), e
        dropped(old)
        roots = e.select(F.col("p").alias("r")).distinct()
        deep = e.join(roots, e.u == roots.r, "left_semi").limit(1).count()
        forked = 0 if deep else e.groupBy("u").count().filter("count > 1").limit(1).count()
        if not deep and not forked:
            return e.select(F.col("u").alias("node"), F.col("p").alias("root")).unionByName(e.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("x"), F.col("p").alias("y")).unionByName(e.select(F.col("p").alias("x"), F.col("u").alias("y")))
    low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("p")).filter("u != p").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("p").alias("m"))
    moved = e.join(low, "u").filter("p != m").select(F.col("p").alias("u"), F.col("m").alias("p"))
    return moved.unionByName(low.select("u", F.col("m").alias("p"))).distinct()
