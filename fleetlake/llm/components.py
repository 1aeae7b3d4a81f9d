"""Connected components of links too many for one machine, by alternating stars.

A large-star round hangs every node's larger neighbours on the smallest node it knows, a small-star round its
smaller ones; rounds alternate until nothing changes, about as often as the logarithm of the longest path. Each
round's links are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u, v with v < u. Every node's neighbours of the round's side get linked to its least neighbour."""
    both = links.select("u", "v")
    if large:
        both = both.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    met = both.join(least.withColumn("m", F.least("m", "u")), "u")
    if large:
        found = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return found.where("v < u").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (any order, repeats and loops allowed). Returns node, component (the least node reachable), for
    every node with a link to another; no links give an empty table."""
    spark = links.sparkSession
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = shared.written(spark, now, "links")
    state = None
    while True:
        large = shared.written(spark, _star(now, True), "links")
        small = shared.written(spark, _star(large, False), "links")
        mark = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (now, large):
            shared.remove(spark, old.shared_path)
        now = small
        if mark == state:
            break
        state = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
