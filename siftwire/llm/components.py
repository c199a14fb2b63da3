"""Connected components of a link table by alternating large-star and small-star steps.

Each step replaces the neighbours' links of a node by links to the smallest neighbour. A node's minimum is
a partial aggregate and is joined back; the neighbours of a hub stream through that join as rows of two ids
and are never brought together in memory. The steps repeat until the links
are stars around their smallest nodes, which takes a logarithmic number of rounds; every round is checkpointed.

Both sides of the joins are shuffled by the same key in any case, so none is made a broadcast afterwards: that
would be one more job and one more table in the driver for each join of each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.session import checkpointed


def _to_smallest(links: DataFrame) -> DataFrame:
    """Links (u, v) joined with the smallest v of each u, ``m``."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u")


def _link(u: Column | str, v: Column | str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two links to smaller ones, or links to smaller and to larger ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("end")).select("end.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not nodes.where("ups > 1 or (ups > 0 and least = 0)").limit(1).count()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link: the smallest node that links reach.

    Null ends and links of a node with itself are left out, links may repeat. Nodes can have any type with
    an order. No links give no rows.
    """
    edges = checkpointed(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    )
    while not _are_stars(edges):
        both = edges.select(F.explode(F.array(_link("u", "v"), _link("v", "u"))).alias("link")).select("link.*")
        large = _to_smallest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        near = _to_smallest(large)
        own = F.array(_link("u", "m"))
        small = near.select(F.explode(F.when(F.col("v") != F.col("m"), F.concat(own, F.array(_link("v", "m")))).otherwise(own)).alias("link")).select("link.*")
        edges = checkpointed(small.distinct())
    centres = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres.select(F.col("v").alias("node"), F.col("v").alias("component")))
