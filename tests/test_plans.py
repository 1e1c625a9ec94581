"""Properties of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from rowkeeper import checks

USUAL = "/root/testdata/sf0.01"
SMALL_ONE_TASK = {
    "coverage_rank", "custom_order", "multi_key_sort", "numeric_text_sort", "oncall_notice", "sortedness_check",
    "one_row_cross", "table_clone", "common_multiset", "alert_rows", "integrity_messages", "collect_archive",
    "catalog_columns", "pii_columns", "staged_insert_bounded", "change_table", "collect_integrity", "book_next",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(build(spark, USUAL)) for name, build in checks.QUERIES.items()}


def test_no_cross_joins_and_no_python(plans):
    for name, text in plans.items():
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text), name
        assert not re.search("Python|ArrowEval|InPandas", text), name


def test_one_task_steps_are_known(plans):
    assert {name for name, text in plans.items() if "SinglePartition" in text} <= SMALL_ONE_TASK


@pytest.mark.parametrize("name", [
    "retention_candidates", "size_buckets", "fixed_chunks", "run_changes", "circular_sum", "systematic_sample", "id_list",
    "nearest_each_side", "concordance_counts", "oncall_sync", "island_heads", "kth_row", "next_in_queue",
])
def test_one_shuffle(plans, name):
    assert len(re.findall("Exchange ", plans[name])) == 1


@pytest.mark.parametrize("name", ["kth_row", "next_in_queue", "sample_per_source", "audit_sample"])
def test_top_rows_are_cut_before_the_shuffle(plans, name):
    assert re.search("WindowGroupLimit.*Final(.|\n)*Exchange(.|\n)*WindowGroupLimit.*Partial", plans[name])


def test_scans_read_only_what_is_needed(plans):
    assert "ReadSchema: struct<o_custkey:bigint,o_orderpriority" not in plans["id_list"]
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plans["id_list"]


def test_ranked_table_has_no_single_task_when_large(spark, few_hot_rows):
    text = plan(checks.QUERIES["custom_order"](spark, USUAL))
    rows_window = text.split("Window")[1]
    assert "hashpartitioning(_slice" in text and "SinglePartition" not in rows_window.split("Exchange")[1][:40]


def test_copy_of_one_target_reads_one_folder(spark, tmp_path):
    from rowkeeper.operators.maintenance import split_by_target, target_copy

    df = spark.range(60).withColumn("target", (F.col("id") % 6).cast("int"))
    split_by_target(df, "target", str(tmp_path / "t"))
    copy = target_copy(spark, str(tmp_path / "t"), "target", 4)
    assert copy.count() == 10 and "PartitionFilters: [isnotnull(target" in plan(copy)


def test_written_partitions_are_rebalanced(spark, tmp_path):
    from rowkeeper.sources.versions import read_table
    from rowkeeper.sources.writers import replace_table

    df = spark.range(100).withColumn("p", F.lit(1))
    replace_table(df, str(tmp_path / "t"), "p")
    assert "RebalancePartitions" in df.hint("rebalance", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert read_table(spark, str(tmp_path / "t")).count() == 100


def test_bounds_of_new_rows_reach_the_scan(spark, tmp_path):
    """The least mark and the bounds of a staged batch are pushed to the scan of the large side."""
    from rowkeeper.operators.maintenance import incremental_rows
    from rowkeeper.sources.writers import staged_insert

    rows = spark.range(1_000).withColumn("source", F.lit("a"))
    rows.repartition(4).sortWithinPartitions("id").write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows"))
    marks = spark.createDataFrame([("a", 900), ("b", 950)], "source string, mark bigint")
    new = incremental_rows(table, marks, "source", "id", listed=True)
    assert new.count() == 99
    assert re.search(r"PushedFilters: \[[^]]*GreaterThan\(id,ScalarSubquery", plan(new))
    spark.range(990, 1_010).withColumn("source", F.lit("a")).write.parquet(str(tmp_path / "staging"))
    staging = spark.read.parquet(str(tmp_path / "staging"))
    staged = staged_insert(table, staging, ["id"], bounded=["id"])
    assert staged.count() == 10
    assert re.search(r"PushedFilters: \[[^]]*(GreaterThanOrEqual\(id,ScalarSubquery.*LessThanOrEqual\(id,ScalarSubquery)", plan(staged))


def test_a_keyed_stream_does_not_read_its_output(spark, tmp_path):
    from rowkeeper.streaming.collect import stream_collect

    spark.range(10).write.parquet(str(tmp_path / "in"))
    query = stream_collect(spark, str(tmp_path / "in"), "id bigint", str(tmp_path / "out"), str(tmp_path / "ckpt"), keys=["id"])
    query.awaitTermination()
    text = query._jsq.explainInternal(False)
    assert "StreamingDeduplicate" in text and str(tmp_path / "out") not in text
    assert query.lastProgress["stateOperators"][0]["customMetrics"]["rocksdbPutCount"] >= 0 if query.lastProgress else True
