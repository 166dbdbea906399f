"""Scans (running aggregates) over a dense index, in two phases.

The index is cut into blocks. Blocks are reduced, the few block results are scanned, and a window
over each block alone starts from its block's offset. So no window spans the whole table: the only
one without partitions runs over the results of super-blocks, one row for each BLOCK * FAN indexes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import functors
from ridgeline.functions.functors import Functor

#: Indexes of a block, and blocks of a super-block.
BLOCK, FAN = 1 << 16, 1 << 12


def _frame(order: str, *keys: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(order: str, *keys: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _offsets(blocks: DataFrame, functor: Functor, kind: str) -> DataFrame:
    """(block, offset) of (block, total): what all blocks before give together."""
    tops = blocks.groupBy(F.floor(F.col("block") / FAN).alias("top")).agg(functor.aggregate(F.col("total")).alias("top_total"))
    # One row for each super-block.
    tops = tops.select("top", F.coalesce(functor.aggregate(F.col("top_total")).over(_before("top")), functor.over_nothing(kind)).alias("top_offset"))
    inner = blocks.withColumn("top", F.floor(F.col("block") / FAN)).withColumn("own", F.coalesce(functor.aggregate(F.col("total")).over(_before("block", "top")), functor.over_nothing(kind)))
    return inner.join(tops, "top").select("block", functor.combine(F.col("top_offset"), F.col("own")).alias("offset"))


def scan(vector: DataFrame, functor: str | Functor = "plus", exclusive: bool = False, between: tuple[int | None, int | None] = (None, None), index: str = "i", value: str = "v", keep_outside: bool = False, block: int = BLOCK) -> DataFrame:
    """vector with column `scan`: the reduction of all values from the range's begin to each index, without its own if exclusive.

    Rows outside the range are left out, or, with keep_outside, keep their value as scan.
    """
    functor = functors.of(functor)
    begin, end = between
    inside = F.lit(True)
    if begin is not None:
        inside = inside & (F.col(index) >= begin)
    if end is not None:
        inside = inside & (F.col(index) < end)
    kind = dict(vector.select(value).dtypes)[value]
    rows = vector.where(inside).withColumn("__block", F.floor(F.col(index) / block))
    totals = rows.groupBy(F.col("__block").alias("block")).agg(functor.aggregate(F.col(value)).alias("total"))
    kind = dict(totals.dtypes)["total"]
    offsets = _offsets(totals, functor, kind).withColumnRenamed("block", "__block")
    frame = _before(index, "__block") if exclusive else _frame(index, "__block")
    local = F.coalesce(functor.aggregate(F.col(value)).over(frame), functor.over_nothing(kind))
    out = rows.withColumn("__local", local).join(offsets, "__block").withColumn("scan", functor.combine(F.col("offset"), F.col("__local")))
    out = out.select(*vector.columns, "scan")
    if keep_outside:
        out = out.unionByName(vector.where(~inside).withColumn("scan", F.col(value).cast(kind)))
    return out


def row_numbers(rows: DataFrame, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """rows with their place from 0 in the order of a unique integer column; gaps in it do no harm."""
    counts = rows.groupBy(F.floor(F.col(order) / block).alias("block")).agg(F.count(F.lit(1)).alias("total"))
    offsets = _offsets(counts, functors.PLUS, "bigint").withColumnRenamed("block", "__block")
    local = F.row_number().over(Window.partitionBy("__block").orderBy(order)) - 1
    return rows.withColumn("__block", F.floor(F.col(order) / block)).withColumn("__local", local).join(offsets, "__block").withColumn(name, (F.col("offset") + F.col("__local")).cast("bigint")).select(*rows.columns, name)


def segmented_scan(vector: DataFrame, functor: str | Functor = "plus", exclusive: bool = False, index: str = "i", value: str = "v", flag: str = "flag", block: int = BLOCK) -> DataFrame:
    """vector with column `scan`: a scan that starts anew at each true flag, and at the least index.

    Works in blocks too, so one segment that fills the table is no task of its own: a block hands on
    what stands after its last flag, and takes what the blocks before hand on up to its first.
    """
    functor = functors.of(functor)
    rows = vector.withColumn("__block", F.floor(F.col(index) / block))
    rows = rows.withColumn("__part", F.sum(F.col(flag).cast("int")).over(_frame(index, "__block")))
    parts = rows.groupBy(F.col("__block").alias("block"), F.col("__part").alias("part")).agg(functor.aggregate(F.col(value)).alias("total"))
    kind = dict(parts.dtypes)["total"]
    # One row for each block: whether it has a flag, and the reduction after its last one.
    blocks = parts.groupBy("block").agg(F.max(F.struct("part", "total")).alias("last")).select("block", (F.col("last.part") > 0).alias("starts"), F.col("last.total").alias("tail"))
    order = Window.orderBy("block")
    blocks = blocks.withColumn("run", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = blocks.withColumn("carried", functor.aggregate(F.col("tail")).over(_frame("block", "run")))
    carry = blocks.select("block", F.lag("carried").over(order).alias("carry"))
    frame = _before(index, "__block", "__part") if exclusive else _frame(index, "__block", "__part")
    local = F.coalesce(functor.aggregate(F.col(value)).over(frame), functor.over_nothing(kind))
    joined = rows.withColumn("__local", local).join(carry.withColumnRenamed("block", "__block"), "__block")
    first = (F.col("__part") == 0) & F.col("carry").isNotNull()
    return joined.withColumn("scan", F.when(first, functor.combine(F.col("carry"), F.col("__local"))).otherwise(F.col("__local"))).select(*vector.columns, "scan")


def running(value: Column, functor: str | Functor, order: str, *keys: str, exclusive: bool = False, kind: str = "double") -> Column:
    """A scan inside groups of a bounded size, as a window expression."""
    functor = functors.of(functor)
    frame = _before(order, *keys) if exclusive else _frame(order, *keys)
    return F.coalesce(functor.aggregate(value).over(frame), functor.over_nothing(kind))
