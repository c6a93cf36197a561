"""Connected components of a graph given as edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelforge.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each vertex hands its larger (or smaller) neighbours to the smallest vertex around it."""
    if large:
        near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    hand = near.join(least, "a")
    keep = hand.where(F.col("b") > F.col("a")) if large else hand.unionAll(least.select("a", F.col("a").alias("b"), "m"))
    return keep.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b): the component is its smallest vertex. No edges, no rows.

    Large-star and small-star steps in turn until the edges are stars around the smallest vertices; rounds grow with
    the logarithm of the longest path. Each round is written, so no round is computed twice.
    """
    now = written(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
        now = written(_star(_star(now, True), False), "edges")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)
