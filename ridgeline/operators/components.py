"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b.

    Large: every neighbour above a node is linked to the least of the node and its neighbours.
    Small: a node and its neighbours below are linked to the least of them.
    """
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        arcs = arcs.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = arcs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a != b").distinct()


def _written(edges: DataFrame, work: Workspace) -> tuple[DataFrame, dict]:
    """The written edges, with their number and an order-free digest; equal states mean that a step changed nothing."""
    return work.measured(edges, n=F.count(F.lit(1)), digest=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the least id reachable.

    Edges may repeat and point either way. Every step is a partial aggregation and a join on the
    node, so a node with very many neighbours is split by skew handling; nothing is collected but
    one row of counts a step. Each step's table is written to the shared folder.
    """
    now, state = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), work)
    while state["n"]:
        after, new = _written(_star(_star(now, True), False), work)
        work.drop(now)
        now, was, state = after, state, new
        if state == was:
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
