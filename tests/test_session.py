"""Intermediate tables: where they go, what they count, and when they go away."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wildloom import session
from wildloom.operators.skew import lookup_join


def unset(master):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda name, default=None: default))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(unset(master))


def test_local_masters_are_told_apart():
    assert session._local(unset("local")) and session._local(unset("local[4]")) and not session._local(unset("local-cluster[2,1,1024]"))


def test_stored_tables_count_and_are_released(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 3 > 0, F.col("id")))
    kept, n = session.stored_counting(df, "t", F.col("x").isNotNull())
    assert n == 66 and kept.count() == 100 and kept.dtypes == df.dtypes
    empty, none = session.stored_counting(df.limit(0), "t", F.lit(True))
    assert none == 0 and empty.isEmpty()
    folder = session.scratch_dir(spark)
    assert folder.startswith(session.checkpoint_dir(spark)) and session.exists(spark, folder)
    session.release(spark)
    assert not session.exists(spark, folder)
    assert session.exists(spark, session.scratch_dir(spark))


def test_known_totals_decide_whether_keys_are_set_apart(spark):
    rows = spark.range(1000).selectExpr("if(id < 900, 1, id) as k", "id as x")
    side = spark.createDataFrame([(1, "a"), (950, "b")], "k long, name string")
    small, large = lookup_join(rows, side, "k", total=1000), lookup_join(rows, side, "k", total=10**9)
    assert small.count() == large.count() == lookup_join(rows, side, "k").count() == 901
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "Union" not in small._jdf.queryExecution().optimizedPlan().toString()
