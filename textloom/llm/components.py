"""Connected components of an undirected graph with joins and aggregations only.

Alternating large-star and small-star steps (Kiveris et al., 2014). Each step gives every node's
neighbours the node's smallest neighbour. Minima are taken per (node, salt) first and handed back
per (node, salt), so a hub with a third of all edges is never one task's work. Edges are written
to the shared folder after each round, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialize, salt_of, spread_back

SALTS = 32
MAX_ROUNDS = 60


def _with_minimum(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and all its v."""
    salted = edges.withColumn("salt", salt_of(F.col("v"), SALTS))
    by_salt = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = by_salt.groupBy("u").agg(F.least(F.col("u"), F.min("m")).alias("m"), F.collect_set("salt").alias("salts"))
    return spread_back(salted, "u", "salt", least, "inner")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    star = _with_minimum(both)
    return star.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    star = _with_minimum(edges)
    linked = star.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(star.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that reaches a smaller one; component is the smallest. Nodes left out are their own."""
    now = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        new = materialize(_small_star(_large_star(now)), "edges")
        # the edges are stars once a round changes nothing; count and checksum tell, and are exact to a hash collision
        state = new.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20, 0)")).alias("h")).first()
        discard(now)
        now = new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
