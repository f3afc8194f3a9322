"""Connected components of an edge table by alternating large and small stars.

Each round is written to the shared folder, so lineage stays short and a lost
executor repeats a round at most. Only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def checksum(*cols):
    """Aggregates (n, s) that tell sets of distinct rows apart; neither can overflow at any size."""
    return F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("s")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge that isn't its component's smallest node.

    ``edges`` has long columns a and b in any order; loops and repeats do no harm.
    """

    def state(df):
        return df.agg(*checksum("hi", "lo")).first()

    star = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    star = materialize(star, "edges")
    before = state(star)
    while before.n:
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(star.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        star = materialize(small.select("e.hi", "e.lo").where("hi <> lo").distinct(), "stars")
        after = state(star)
        if after == before:
            break
        before = after
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
