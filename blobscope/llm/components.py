"""Connected components of links, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, root): root is the smallest node that can be reached.

    Each round attaches the larger neighbours of every node to its smallest one (large star), then all
    smaller neighbours to theirs (small star), until nothing changes, in a logarithmic number of rounds. A
    node's neighbours are never gathered in a list: minima are pre-aggregated, written and joined, so adaptive
    execution splits a node with very many links. Every round ends in a written table. Self links and repeated links are allowed; an empty
    table has no components."""
    edges = materialize(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are tables of their own, so that a join with a hot node can be split
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large-stars")
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lower, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        done, edges = edges, materialize(small, "links")
        discard(done, low, large, lower)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
