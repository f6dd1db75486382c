"""Connected components of a link table by alternating large and small stars.

Every round is a minimum per node and a join back, so a hub with many links is pre-aggregated on the map side
and split by adaptive execution; nothing is collected.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.store import release, settle


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link to another; ``root`` is the least node of its component."""
    edges = settle(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("_m")).select(F.col("hi").alias("_u"), F.least("hi", "_m").alias("_m"))
        large = both.join(least, F.col("hi") == F.col("_u")).filter("lo > hi").select(F.col("lo").alias("hi"), F.col("_m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("_m"))
        small = (large.join(down, "hi").filter("lo <> _m").select(F.col("lo").alias("hi"), F.col("_m").alias("lo"))
                 .unionByName(down.select("hi", F.col("_m").alias("lo"))).distinct())
        after = settle(small, "edges")
        release(edges)
        edges, before, mark = after, mark, _mark(after)
        if before == mark:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
