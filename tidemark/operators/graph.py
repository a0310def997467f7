"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): id and its component's smallest id, for every id in an edge.

    Each id is hooked to its smallest neighbour if that is smaller, the pointers are doubled until they
    end at roots, and the edges are carried over to the roots, until none is left. Every step is a join
    or a sum by key over edges, written to the shared folder; what no later step reads is deleted.
    Edges with a null end and loops are left out.
    """
    edges = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        parents = materialize(edges.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("p")))
        while True:
            above = parents.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            doubled = materialize(parents.join(above, "p", "left").select("id", F.coalesce("pp", "p").alias("q"), "p"))
            discard(parents)
            moved = not doubled.where("p <> q").isEmpty()
            parents = doubled.select("id", F.col("q").alias("p"))
            parents._materialized_at = doubled._materialized_at
            if not moved:
                break
        if labels is None:
            labels, spare = parents, None
        else:
            old, spare = labels, parents
            labels = materialize(labels.join(parents.select(F.col("id").alias("p"), F.col("p").alias("pp")), "p", "left").select("id", F.coalesce("pp", "p").alias("p")))
            discard(old)
        roots = parents.select(F.col("id").alias("a"), F.col("p").alias("ra"))
        carried = edges.join(roots, "a").join(roots.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        carried = materialize(carried.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct())
        discard(edges, spare)
        edges = carried
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    discard(edges)
    out = labels.select("id", F.col("p").alias("component"))
    out._materialized_at = labels._materialized_at
    return out
