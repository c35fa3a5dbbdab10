"""Connected components of a graph that only exists as a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, fitted


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in `edges`; the component is its smallest node.

    Alternating large-star and small-star rounds: every step links the neighbours of a node to its
    smallest neighbour, so long chains halve. A hub's neighbours are never gathered; a step is an aggregate
    with map-side combine and an equi join that adaptive execution can split. Each step is checkpointed, so that a task holds
    the buffers of one step only, and runs in as many tasks as its links are worth.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = durable(links)
    seen = _state(links)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        links = durable(_large_star(fitted(links, seen[0]), seen[0]))
        links = durable(_small_star(fitted(links, seen[0]), seen[0]))
        state = _state(links)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(links: DataFrame) -> tuple:
    """Number of links and an order-free checksum of them."""
    return tuple(links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
    ).first())


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return fitted(fitted(moved, n).distinct(), n)


def _small_star(links: DataFrame, n: int) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    to_least = F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u"))  # the least neighbour links its own node to it
    moved = links.join(least, "u").select(to_least.alias("u"), F.col("m").alias("v"))
    return fitted(fitted(moved, n).distinct(), n)
