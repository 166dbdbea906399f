"""Sorting, order checks and permutations of vectors (i, v)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import Workspace


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place from 0 in an order that should be total.

    A range exchange, a sort inside each partition, and a scan of the partitions' sizes: no task sees
    more than its range. The sorted table is written once, so that places hold when tasks are repeated.
    """
    work = Workspace(rows.sparkSession, "numbered")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    written = work.write(dealt)
    part, local = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    split = written.withColumn("__part", part).withColumn("__local", local)
    sizes = split.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row a partition
    return split.join(F.broadcast(offsets), "__part").withColumn(name, (F.col("__before") + F.col("__local")).cast("bigint")).select(*rows.columns, name)


def sort(vector: DataFrame, descending: bool = False, key: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """The vector in the order of its values' keys, ties in their old order, indexed anew from 0."""
    by = key(F.col("v"))
    keyed = vector.select("i", "v", by.alias("__key"))
    out = numbered(keyed, "place", F.desc("__key") if descending else F.asc("__key"), F.asc("i"))
    return out.select(F.col("place").alias("i"), "v")


def sort_range(vector: DataFrame, begin: int, end: int, descending: bool = False, key: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """The vector with the elements of places begin to end (exclusive) in order; the others keep their places."""
    inside = (F.col("i") >= begin) & (F.col("i") < end)
    moved = sort(vector.where(inside), descending, key).select((F.col("i") + begin).alias("i"), "v")
    return vector.where(~inside).select("i", "v").unionByName(moved)


def is_sorted(vector: DataFrame, descending: bool = False) -> DataFrame:
    """One row: whether no element stands before one that belongs ahead of it. True over at most one element."""
    next_ = vector.select((F.col("i") - 1).alias("i"), F.col("v").alias("next"))
    wrong = F.col("next") > F.col("v") if descending else F.col("next") < F.col("v")
    return vector.select("i", "v").join(next_, "i").agg(F.coalesce(F.bool_and(~wrong), F.lit(True)).alias("value"))


def permute(vector: DataFrame, permutation: DataFrame) -> DataFrame:
    """The vector with element i at the place new of the permutation (old, new)."""
    return vector.join(permutation, vector["i"] == permutation["old"]).select(F.col("new").alias("i"), "v")


def inverse(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("new").alias("old"), F.col("old").alias("new"))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order: each task keeps n, and one task merges these."""
    return rows.orderBy(*order).limit(n)
