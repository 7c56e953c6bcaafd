"""Connected components by repeated contraction; nothing but "is there more" reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stage


def _edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return (
        pairs.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
        .distinct()
    )


def components(pairs: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """``id, component``: the smallest id reachable, for every id that has an edge to another.

    Each round every vertex hooks to its smallest neighbour if that is smaller, hooks are
    followed two steps, and the graph is contracted: edges take the new names of their ends,
    and those inside one vertex go. What is left shrinks fast, in dense groups at once. Every round
    is written to the shared folder. Self-loops, repeated and turned edges are fine. ``rows`` is a bound on the pairs, if one is known;
    the tables of a round have at most two rows for each edge left.
    """
    left = stage(_edges(pairs, a, b), "edges", rows)
    labels, ids = None, 0
    while n := left.count():
        ids = ids or 2 * n
        both = left.unionByName(left.select(F.col("y").alias("x"), F.col("x").alias("y")))
        hooks = stage(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("up")), "hooks", 2 * n)
        via = hooks.select(F.col("x").alias("up"), F.col("up").alias("further"))
        jumped = stage(hooks.join(via, "up").select("x", F.col("further").alias("up")), "hooks", 2 * n)
        if labels is None:
            labels = jumped.select(F.col("x").alias("id"), F.col("up").alias("component"))
        else:
            to = jumped.select(F.col("x").alias("component"), "up")
            labels = labels.join(to, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        labels = stage(labels, "labels", ids)
        ends = jumped.select("x", F.col("up").alias("to_x")), jumped.select(F.col("x").alias("y"), F.col("up").alias("to_y"))
        left = stage(_edges(left.join(ends[0], "x").join(ends[1], "y"), "to_x", "to_y"), "edges", n)
    if labels is None:
        labels = left.select(F.col("x").alias("id"), F.col("y").alias("component"))
    return labels
