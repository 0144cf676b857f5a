"""Connected components by smallest members, in joins and aggregates only.

Every node with a smaller neighbour hooks to the smallest one, which makes a forest; pointers are
doubled until each node knows its root; edges are renamed to roots, and what is left is a smaller
graph to treat the same way. A node with very many neighbours is an aggregate with map-side
combining and joins of stored tables, which runtime skew handling can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekeep.session import materialize


def forest_roots(parents: DataFrame, merged: bool = False) -> DataFrame:
    """(node, root) from parents(node, root) with one smaller parent per node, by pointer doubling.

    ``merged`` keeps Spark from broadcasting the table, whose rows may be many times their stored size.
    """
    table = materialize(parents.select("node", "root"), "forest")
    while True:
        up = table.toDF("middle", "above")
        up = up.hint("merge") if merged else up
        jump = table.join(up, F.col("root") == F.col("middle"), "left")
        jumped = materialize(jump.select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "forest")
        table = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return table


def rename(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs(a, b) between different roots: (node, root) with the larger one first, each once."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.toDF(c, f"r{c}"), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
    return ordered(pairs)


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()


def compose(roots: DataFrame | None, later: DataFrame) -> DataFrame:
    """(node, root) after the roots themselves got roots."""
    if roots is None:
        return later
    moved = roots.join(later.toDF("old", "new"), F.col("root") == F.col("old"), "left")
    return materialize(moved.select("node", F.coalesce("new", "root").alias("root")).union(later), "roots")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of links(a, b) for every node but the roots; a component has one root, its smallest node."""
    edges, roots = materialize(ordered(links), "links"), None
    while True:
        found = forest_roots(edges.groupBy("node").agg(F.min("root").alias("root")))
        roots = compose(roots, found)
        edges = materialize(rename(edges.toDF("a", "b"), found), "links")
        if edges.isEmpty():
            return roots
