"""Connected components of a link table, by alternating star contractions.

Each round replaces links by links to the least neighbour: first every node
hands its larger neighbours to its least one, then its smaller ones.  The
links end as stars around the least id of each component, after a number of
rounds that grows with the logarithm of the size.  All steps are groupings
and joins; a node's neighbours are only ever aggregated to a minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratestat.llm.common import staged


def _hand_over(pairs: DataFrame) -> DataFrame:
    """pairs(u, v): every v and u itself linked to the least of u's group."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _state(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b); the component is its
    least node.  Nodes without a link don't appear."""
    links = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "links")
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _hand_over(both).where("a > b").distinct()
        small = _hand_over(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        links = staged(small.where("a > b").distinct(), "links")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component")).distinct()
