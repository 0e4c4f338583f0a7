"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.storage import discard, materialize


def _toward(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Each u with the smallest node among itself and its v."""
    return edges.groupBy(F.col(u).alias("u")).agg(F.least(F.col("u"), F.min(v)).alias("m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that can be reached from node over ``edges``.

    Only nodes of edges between different nodes appear. Self-loops, nulls and repeated edges are ignored;
    without edges the result is empty. Each round is written to the shared folder, so lineage stays short
    and a lost executor costs one round. Minima are taken before a shuffle, and a node with very many
    neighbours meets a table with one row for each node, a join that adaptive execution can split.
    The number of rounds grows with the logarithm of the longest path squared at most.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    for _ in range(rounds):
        # large star: larger neighbours of a node move to the smallest of its neighbourhood
        both = e.select(F.col("x").alias("u"), F.col("y").alias("v")).union(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = materialize(_toward(both, "u", "v"))
        large = e.select(F.col("y").alias("u"), F.col("x").alias("v")).join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y")
        # an edge whose lower end is its neighbourhood's smallest stays; others also tie that end to it
        own = least.where("u <> m").select(F.col("u").alias("x"), F.col("m").alias("y"))
        large = materialize(large.union(own).distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        down = materialize(_toward(large, "x", "y"))
        small = large.select(F.col("x").alias("u"), F.col("y").alias("v")).join(down, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y")
        nxt = materialize(small.union(down.select(F.col("u").alias("x"), F.col("m").alias("y"))).distinct())
        n = nxt.agg(F.count(F.lit(1)), F.count_distinct("x")).first()
        inner = nxt.select("x").join(nxt.select(F.col("y").alias("x")).distinct(), "x", "left_semi").limit(1).count()
        discard(least, large, down, e)
        e = nxt
        if n[0] == n[1] and not inner:  # a star for each component
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("x").alias("node"), F.col("y").alias("component")).union(e.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
