"""Connected components of a link table by alternating large-star and small-star steps.

Every round is a handful of key aggregations and joins over the link table
(no adjacency list is ever collected, no link reaches the driver); the links
of a round are written under ``spark.checkpoint.dir``, so lineage stays short
and a lost executor costs re-reading files.  A vertex with very many links
(a third of all rows) is reduced by partial aggregates and met again in a
join, whose skewed partition AQE splits.  The number of rounds grows with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.session import materialize


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def connected_components(links: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, root) for every node named in ``links``; root is the smallest node of its component.

    Rows with a null end, and links of a node to itself, join nothing and are left out.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                        .filter("u is not null and v is not null and u <> v").distinct(), name)
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = materialize(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))))
        edges = materialize(small.distinct(), name)
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
