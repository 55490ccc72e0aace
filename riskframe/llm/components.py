"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import Tables, cut


def _ordered(edges: DataFrame) -> DataFrame:
    return (edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _ranked(node: str) -> Column:
    """Nodes in an order that has nothing to do with their numbers."""
    return F.struct(F.xxhash64(F.col(node).cast("string")).alias("rank"), F.col(node).alias("node"))


def _roots(points: DataFrame, tables: Tables) -> DataFrame:
    """Pointers (a, to) followed to their ends, doubling their reach until none moves."""
    while True:
        step = points.select(F.col("a").alias("to"), F.col("to").alias("further"))
        followed = tables.keep(points.join(step, "to").select(
            "a", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
        points = followed.select("a", "to")
        if followed.where("moved").isEmpty():
            return points


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge (a, b); component is the smallest node reachable.

    Each round every node points to the neighbour of lowest random rank, or to itself, pointers are followed to
    their ends, and the edges are rewritten to those. Only nodes below all their neighbours stay, at most half of
    those on an edge and a third of a chain, so rounds are logarithmic whatever the order of the numbers; random
    ranks keep the pointer chains short as well. Both sides of every join are read from files, so size estimates
    stay those of the data and adaptive execution can split a hub. Self-loops, repeated edges and edges with a null
    end are ignored; no edges give no rows.
    """
    tables = Tables(edges.sparkSession, "components")
    left = tables.keep(_ordered(edges))
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = _roots(tables.keep(
            both.groupBy("a").agg(F.min(_ranked("b")).alias("low"))
            .select("a", F.least("low", _ranked("a"))["node"].alias("to"))), tables)
        one = points.select("a", F.col("to").alias("x"))
        two = points.select(F.col("a").alias("b"), F.col("to").alias("y"))
        left = tables.keep(_ordered(left.join(one, "a").join(two, "b")
                                    .select(F.col("x").alias("a"), F.col("y").alias("b"))))
        moved = points.select(F.col("a").alias("component"), "to")
        labels = tables.keep(points.select(F.col("a").alias("node"), F.col("to").alias("component"))
                             if labels is None else labels.join(moved, "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")))
        tables.drop(last=2)
    if labels is None:
        out = cut(left.select(F.col("a").alias("node"), F.col("b").alias("component")))
    else:
        lowest = labels.groupBy("component").agg(F.min("node").alias("lowest"))
        out = cut(labels.join(lowest, "component").select("node", F.col("lowest").alias("component")))
    tables.drop()
    return out
