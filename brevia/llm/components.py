"""Connected components of a table of links, by alternating stars.

Large-star links every larger neighbour of a node to the smallest node near it, small-star every
smaller one; both keep the components and, alternated, end in stars round each component's
smallest node after a number of rounds that grows with the logarithm of the longest chain. Every
round is two aggregations and joins on the node, cut into the shared folder; nothing but one count
and one checksum a round reaches the driver. Nodes of very many links are joined by a bounded
broadcast. Links with a null end are no links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevia.llm.shared import HOT_ROWS, cut, spread_join


def _large_star(edges: DataFrame, n: int, degree: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return spread_join(both.filter("v > u"), least, "u", 2 * n, degree).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame, n: int, degree: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = spread_join(down, least, "u", n, degree).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Links, a checksum of them, and the most links of a node."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("u"), F.xxhash64("u", "v").cast("decimal(38,0)").alias("h"))
    nodes = ends.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
    return tuple(nodes.agg(F.coalesce(F.sum("n"), F.lit(0)) / 2, F.sum("h"), F.coalesce(F.max("n"), F.lit(0))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v), long links of any direction -> (node, root): root is the smallest node reachable.

    Only nodes other than their own root have a row. No links give no rows. Loops and repeated
    links change nothing.
    """
    edges = cut(edges.select("u", "v").filter("u != v").distinct(), True)
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        n, _, degree = state
        large = _large_star(edges, n, degree)
        if degree > HOT_ROWS:  # a node that many others meet may be near more of them now
            large = cut(large, True)
            n, _, degree = _state(large)
        edges = cut(_small_star(large, n, degree), True)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
