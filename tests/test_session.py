"""Written tables: removal by frame, by workspace and by session, and buckets."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ridgeline import session
from ridgeline.session import Workspace


def exists(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_tables_go_by_frame_workspace_and_session(spark):
    before = session.roots()
    one, two = Workspace(spark, "one"), Workspace(spark, "two")
    a, b = one.write(spark.range(3)), one.write(spark.range(4))
    c, seen = two.measured(spark.range(5), n=F.count(F.lit(1)), most=F.max("id"))
    assert seen == {"n": 5, "most": 4} and session.roots() == before + 2
    one.drop(a, spark.range(1))
    assert not exists(spark, f"{one.root}/1") and b.count() == 4
    one.close()
    assert not exists(spark, one.root) and session.roots() == before + 1
    assert c.count() == 5
    session.sweep(spark, before)
    assert not exists(spark, two.root) and session.roots() == before


def test_buckets_are_read_without_an_exchange(spark):
    work = Workspace(spark, "buckets")
    table, seen = work.bucketed(spark.range(1000).select((F.col("id") % 50).alias("k"), "id"), "k", n=F.count(F.lit(1)))
    assert seen["n"] == 1000
    plan = table.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and table.groupBy("k").count().count() == 50
    name = next(iter(work.tables.values()))
    work.drop(table)
    assert not spark.catalog.tableExists(name)
    work.close()


def test_executors_elsewhere_need_a_shared_folder():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda key: None), _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context))
