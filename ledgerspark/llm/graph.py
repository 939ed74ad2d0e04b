"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of ``edges`` (columns a, b); the component is
    the smallest node reachable.

    Each round every node takes its smallest neighbour if smaller, a pointer
    jump shortens the chains, and the edges are rewritten to the new names, so
    the graph shrinks by its inner edges. Only sums and minima are grouped
    (partial before the shuffle): a hub with any number of links is no hot task.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    rounds = 0
    names = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not is_empty(edges):
        up = edges.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("to"))
        nxt = up.select(F.col("n").alias("to"), F.col("to").alias("further"))
        up = materialize(up.join(nxt, "to", "left").select("n", F.coalesce("further", "to").alias("to")))
        names = names.join(up, names["component"] == up["n"], "left").select("node", F.coalesce("to", "component").alias("component"))
        a, b = up.select(F.col("n").alias("a"), F.col("to").alias("to_a")), up.select(F.col("n").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(
            F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        edges = materialize(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        rounds += 1
        if rounds % 4 == 0:  # keep the plan short
            names = materialize(names)
    return names
