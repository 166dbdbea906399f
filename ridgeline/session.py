"""Session set-up and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Runtime settings the plans rely on; all are public Spark SQL settings.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME, "spark.ui.enabled": "false", "spark.driver.memory": "4g", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 1 << 19


def small_batches(spark: SparkSession) -> None:
    """From now on batches to Python workers end at BATCH_BYTES; a lower bound of the session stays.

    Spark's own bound is 64 MB, which the executor holds outside its heap and the worker as Arrow and
    as Python objects, for each task. The session keeps the setting: frames are run after they are made.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: Rows that one task sorts or sums by key at once.
TASK_ROWS = 1 << 20


def dealt(df: DataFrame, rows: int, *keys: str, each: int = TASK_ROWS) -> DataFrame:
    """df of so many rows, exchanged by keys into partitions of about `each`; df itself where one would do.

    Neither the session's number of partitions nor the number of input files bounds a task's rows, and
    partitions that have been asked for are not put together again.
    """
    n = -(-rows // each)
    return df if n <= 1 else df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder serves, but only where driver and executors are one machine;
    elsewhere executors would not see each other's files, so this raises RuntimeError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of the session's workspaces, in the order of their making.
_ROOTS: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables of all workspaces made after the first `since` of them.

    A frame that an operator returns may still read such tables, so its rows must have been written
    or collected. roots() tells how many workspaces there are.
    """
    while len(_ROOTS) > since:
        _delete(spark, _ROOTS.pop())


def roots() -> int:
    """How many workspaces have been made and not been swept."""
    return len(_ROOTS)


class Workspace:
    """Tables written to the shared folder to cut lineage, with removal of those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.written: list[tuple[DataFrame, str]] = []
        self.tables: dict[str, str] = {}
        _ROOTS.append(self.root)

    def write(self, df: DataFrame) -> DataFrame:
        """Writes df once and returns a frame that reads the written table."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.written.append((out, path))
        return out

    def bucketed(self, df: DataFrame, key: str, **aggregates: Column) -> tuple[DataFrame, dict]:
        """Like measured(), with the table dealt to buckets by key, so that joins and sums by key read it without an exchange.

        There are as many buckets as the session has shuffle partitions; a bucket is one sorted file.
        """
        seen = Observation()
        if aggregates:
            df = df.observe(seen, *(a.alias(n) for n, a in aggregates.items()))
        self.count += 1
        path, name = f"{self.root}/{self.count}", f"ridgeline_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        self.written.append((out, path))
        self.tables[path] = name
        return out, seen.get if aggregates else {}

    def plain(self, *frames: DataFrame) -> DataFrame:
        """The rows of tables of this workspace with equal columns, read as files without buckets.

        Spark 4.1 takes a union of bucketed tables for dealt by their key, though its columnar union puts
        one table's partitions behind the other's: a sum by key over it would have rows that repeat.
        """
        paths = [path for df in frames for found, path in self.written if found is df]
        return self.spark.read.schema(frames[0].schema).parquet(*paths)

    def measured(self, df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
        """Like write(), with aggregates over the rows that are gathered while they are written, so they cost no further job."""
        seen = Observation()
        out = self.write(df.observe(seen, *(a.alias(n) for n, a in aggregates.items())))
        return out, seen.get

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the tables behind frames returned by write(); other frames are left alone."""
        for df in frames:
            for entry in [e for e in self.written if e[0] is df]:
                self.written.remove(entry)
                self._forget(entry[1])
                _delete(self.spark, entry[1])

    def close(self) -> None:
        """Deletes all tables of this workspace."""
        self.written.clear()
        for path in list(self.tables):
            self._forget(path)
        if self.root in _ROOTS:
            _ROOTS.remove(self.root)
        _delete(self.spark, self.root)

    def _forget(self, path: str) -> None:
        """Takes a bucketed table's name out of the catalogue."""
        if name := self.tables.pop(path, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
