"""Reductions of streams of elements (time, key, v): per window with a watermark for late rows, or since the start.

These are the grouped reductions of ridgeline.operators.segments with an unbounded input; state is
one partial result a group, kept by Spark's state store in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgeline.functions import functors
from ridgeline.functions.functors import Functor


def windowed(stream: DataFrame, functor: str | Functor, time: str, value: str, window: str, slide: str | None = None, late: str = "0 seconds", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., start, end, value) for each tumbling or sliding window; rows later than the watermark are left out."""
    frames = F.window(time, window, slide) if slide else F.window(time, window)
    grouped = stream.withWatermark(time, late).groupBy(*keys, frames.alias("w"))
    return grouped.agg(functors.of(functor).aggregate(F.col(value)).alias("value")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value")


def running(stream: DataFrame, functor: str | Functor, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys..., value): each key's reduction since the start; write it in update or complete mode."""
    return stream.groupBy(*keys).agg(functors.of(functor).aggregate(F.col(value)).alias("value"))


def to_parquet(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the closed windows of a windowed reduction to a Parquet folder, all that is there by now."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
