"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstats.session import cut


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, of every node of edges (a, b) that is not its own label.

    Each round joins a node to the smallest of its neighbours, first on the side of larger ones,
    then of smaller ones; rounds grow with the logarithm of the number of nodes.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = cut(small.filter("a != b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _stars(edges: DataFrame) -> bool:
    """Whether each a has one b, and no b is an a."""
    ends = edges.groupBy("a").agg((F.count("*") > 1).alias("several")).select("several", F.col("a").alias("node"), F.lit(True).alias("left"))
    met = ends.unionByName(edges.select(F.lit(False).alias("several"), F.col("b").alias("node"), F.lit(False).alias("left")))
    odd = met.groupBy("node").agg(F.max("several").alias("several"), (F.max("left") & ~F.min("left")).alias("both"))
    return not odd.filter("several OR both").limit(1).count()
