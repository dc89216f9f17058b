"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.staging import staged


HOT, FEW = 1024, 128


def joined_to_least(edges: DataFrame, least: DataFrame, ends: int, most: int) -> DataFrame:
    """``edges`` (u, v) with ``m`` of their u from ``least`` (u, m, n), n being u's edges in both directions.

    ``ends`` is the sum of all n, ``most`` the largest. A node with more than a ``HOT``-th of all
    ends, and more than ``FEW``, has its ``m`` broadcast: fewer than ``HOT`` nodes have, whatever
    the data. So no task gets a hub's edges. Where there is no such node, there is one join less.
    """
    bound = max(FEW, ends // HOT)
    if most <= bound:
        return edges.join(least.select("u", "m"), "u")
    hot = least.where(F.col("n") > bound).select("u", F.col("m").alias("__hot"))
    marked = edges.join(F.broadcast(hot), "u", "left")
    rest = marked.where("__hot is null").select("u", "v").join(least.select("u", "m"), "u")
    return rest.unionByName(marked.where("__hot is not null").select("u", "v", F.col("__hot").alias("m")))


def stars(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, component`` of each node that has an edge and isn't its component's smallest.

    ``edges`` has the columns ``a`` and ``b``, of one type that has an order. Large-star and
    small-star steps by turns: each links a node's neighbours to the smallest one, until all
    edges are stars. A node's neighbours are never gathered: the minimum is an aggregate, and it is joined back. Edges
    that haven't settled after ``rounds`` are an error, never a result.

    All edges are stars when no node has a smaller neighbour and another one besides. The counts
    that tell this are those a round starts with, so edges that are stars cost no round.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for turn in range(rounds + 1):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n"))
        least = staged(least.select("u", F.least("u", "v").alias("m"), "n"), "least")
        seen = least.agg(F.sum("n"), F.max("n"), F.coalesce(F.bool_or(F.expr("m < u and n > 1")), F.lit(False))).first()
        if not seen[2]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if turn == rounds:
            break
        large = joined_to_least(both.where("v > u"), least, seen[0], seen[1]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct(), "edges")
    raise RuntimeError(f"components haven't settled after {rounds} rounds")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, component`` (its smallest node) of each node that has an edge; see ``stars``."""
    found = stars(edges, rounds)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
