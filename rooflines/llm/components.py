"""Connected components as DataFrame work: alternating large-star and small-star steps over the edges.

Each round is one job over the edges; its result is checkpointed, so lineage stays short and a lost executor costs at
most a round. A node's neighbours are never gathered: each step takes a minimum by partial aggregation and joins it
back with a sort-merge join, which Spark splits at hub nodes. The edges shrink to one star for each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger node u to its smaller v; loops and edges with a null end go."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v of any type with an order. Gives node, component (its smallest node) for each node with an edge to another."""
    now = cut(_down(edges))
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _down(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        now = cut(_down(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
