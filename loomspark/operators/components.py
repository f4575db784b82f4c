"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.scratch import materialize

#: Ends of edges up to which their nodes' smallest neighbours are told to all tasks. Beyond it only hubs' are: at most one for each ``HUB_EDGES`` edges.
MAX_BROADCAST_NODES = 500_000
HUB_EDGES = 4096


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).select("u")
    return twice.unionByName(edges.select("u").distinct().join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1)).isEmpty()


def _with_least(edges: DataFrame, n_edges: int, max_nodes: int) -> DataFrame:
    """(u, v, m) of each edge, m being u's smallest v. No task gets all edges of a hub."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if n_edges <= max_nodes:
        return edges.join(F.broadcast(least.select("u", "m")), "u")
    least = materialize(least, "components-least")
    told = least.select("u", "m")
    hubs = F.broadcast(least.where(F.col("n") > HUB_EDGES).select("u", "m"))
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(told.hint("merge"), "u"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, max_nodes: int = MAX_BROADCAST_NODES, rows: int | None = None) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Each round is two aggregations, combined in the map stage, and two joins in which a hub's edges stay where
    they are: its smallest neighbour is broadcast to them, by its own if few nodes have edges, else with other
    hubs'. Rounds end when the edges are stars around smallest nodes, which takes a number of rounds logarithmic
    in the longest path. Null ends, loops and repeated edges are ignored. Only counts reach the driver. ``rows``
    is the number of edges, if the caller has counted them.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
        "components", rows,
    )
    for _ in range(max_rounds):
        if _stars(now):
            break
        n = 2 * now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, n, max_nodes).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = large if n <= max_nodes else materialize(large, "components-large")
        small = _with_least(large, n, max_nodes)
        now = materialize(
            small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(),
            "components", n,
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
