import pytest
from pyspark.sql import functions as F

from rowkeeper.operators import joins
from rowkeeper.plans.ordered import HOT_ROWS_CONF
from rowkeeper.plans.skew import skew_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(spark, few_hot_rows, how):
    left = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 60}", i) for i in range(600)], "k string, i int")
    left = left.unionByName(spark.createDataFrame([("hot2", i) for i in range(100)] + [(None, 1)], "k string, i int"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("none", 5)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = skew_join(left, right, ["k"], how)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "_salt" in got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_right_and_full_joins_are_refused(spark):
    with pytest.raises(ValueError):
        skew_join(spark.range(1), spark.range(1), ["id"], "full_outer")


def test_history_join_deals_large_sides_to_more_tasks(spark, monkeypatch):
    """However many rows, a task joins and holds about as many as it says; hot keys too."""
    monkeypatch.setattr(joins, "TASK_ROWS", 50)
    left = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"))
    right = spark.range(2_000).select((F.col("id") % 500).alias("k"), F.col("id").alias("y"))
    for hot_rows in ("4000000", "3"):
        spark.conf.set(HOT_ROWS_CONF, hot_rows)
        try:
            found = joins.history_join(left, right, ["k"], ["k", "x", "y"])
        finally:
            spark.conf.unset(HOT_ROWS_CONF)
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == sorted((i % 500, i % 500 % 7, i) for i in range(2_000))
    assert joins.history_join(left, right, ["k"], ["k", "x", "y"]).rdd.getNumPartitions() == 40
    assert joins.history_join(left, right.limit(0), ["k"], ["k", "x", "y"]).count() == 0
