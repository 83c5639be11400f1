"""Connected components of a graph given as links, without collecting anything.

Alternating large-star and small-star rounds: each round points the neighbours of a node at the smallest node around it.
Every half round is a shuffled aggregation with map-side partial minima, whose result is written, and a join with it: both
sides of the join are plain scans then, so a node with a great many links is split among tasks. The links are written to
the shared folder after each half round, which cuts lineage and survives lost executors. Chains shrink by a factor
each round, so rounds grow with the logarithm of the longest one; they end when the links are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written


def _star(links: DataFrame, large: bool) -> tuple[DataFrame, str]:
    """links (a, b), a > b. Large: larger neighbours of each node go to its least neighbour or itself; small: smaller
    neighbours and the node itself do."""
    around = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))) if large else links
    least, path = written(around.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_n"), F.least("a", "_m").alias("_m")))
    joined = around.join(least, F.col("a") == F.col("_n"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(least.select(F.col("_n").alias("a"), F.col("_m").alias("b")))
    result = written(out.filter("a > b").distinct())
    drop(links.sparkSession, path)
    return result


def _stars_only(links: DataFrame) -> bool:
    """Whether each node has one link to a smaller one, or links to larger ones only."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("_up"), F.lit(0).alias("_down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("_up").alias("_up"), F.sum("_down").alias("_down")).filter("_up > 1 or (_up > 0 and _down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of `links` (a long, b long) reaches. Nodes without links are
    not there. Links to the node itself and nulls are left out."""
    now, path = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars_only(now):
        for large in (True, False):
            after, next_path = _star(now, large)
            drop(links.sparkSession, path)
            now, path = after, next_path
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
