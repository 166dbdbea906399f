"""Stream reductions against the same reductions of a table."""

import pytest
from pyspark.sql import functions as F

from ridgeline.streaming import reductions

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))


def test_windows(spark, tmp_path, stream):
    events, incoming = stream
    out = reductions.windowed(incoming, "max", "ts", "value", "1 day", late="2 days", keys=["event_type"])
    reductions.to_parquet(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["event_type"], r["start"]): r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["event_type"], r["w"]["start"]): r["v"] for r in events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.max("value").alias("v")).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_running(spark, tmp_path, stream):
    events, incoming = stream
    query = reductions.running(incoming, "plus", "value", ["event_type"]).writeStream.format("memory").queryName("running_sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["event_type"]: round(r["value"], 4) for r in spark.table("running_sums").collect()}
    assert got == {r["event_type"]: round(r["v"], 4) for r in events.groupBy("event_type").agg(F.sum("value").alias("v")).collect()}
