"""Operators on both sides of their former limits."""

import re

import pytest
from pyspark.sql import functions as F

from rowkeeper.operators import aggregates, joins, maintenance, ordering, reshape, windows
from rowkeeper.plans import fleet
from rowkeeper.plans.ordered import ordered
from rowkeeper.plans.skew import skew_join


def test_kth_row_downward_beyond_the_group_limit(spark):
    df = spark.range(2401).select("id", (F.col("id") % 2).alias("s"), F.when(F.col("id") > 4, F.col("id")).alias("v"))
    for k in (1000, 1001, 1200):
        assert {r.id for r in ordering.kth_row(df, ["-id"], k, ["s"]).collect()} == {2400 - 2 * (k - 1), 2399 - 2 * (k - 1)}
        assert {r.id for r in ordering.kth_row(df, ["s", "-id"], k, ["s"]).collect()} == {2400 - 2 * (k - 1), 2399 - 2 * (k - 1)}
    # Nulls come last.
    assert [(r.s, r.v) for r in ordering.kth_row(df, ["-v"], 1199, ["s"]).orderBy("s").collect()] == [(0, None), (1, None)]
    assert ordering.kth_row(df, ["-v"], 1198, ["s"]).filter("s = 0").first().v == 6


def test_kth_row_downward_in_hot_keys(spark, few_hot_rows):
    df = spark.range(2400).select("id", (F.col("id") % 2).alias("s"))
    assert {r.id for r in ordering.kth_row(df, ["-id"], 1100, ["s"]).collect()} == {200, 201}


def test_kth_row_in_an_order_of_both_directions(spark, few_hot_rows):
    """Place 5,000 of a hot key: text downward, numbers upward, nulls as in a plain sort, and no task sorts the key."""
    df = spark.range(12_000).select(
        "id", F.lit(1).alias("s"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("t"), (F.col("id") % 7).cast("string"))).alias("v"),
        F.when(F.col("id") % 5 > 0, (F.col("id") * 7_919) % 12_007).alias("w"),
    )
    plain = [r.id for r in df.orderBy(F.desc("v"), F.asc("w"), F.desc("id")).collect()]
    for k in (1_001, 5_000, 12_000):
        found = ordering.kth_row(df, ["-v", "w", "-id"], k, ["s"])
        assert [r.id for r in found.collect()] == [plain[k - 1]]
    assert "_slice" in found._jdf.queryExecution().executedPlan().toString()
    places = {r.id: r.rank for r in ordering.multi_key_sort(df, ["-v", "w", "-id"]).collect()}
    assert places == {i: at for at, i in enumerate(plain, 1)}


def test_slices_of_a_key_with_one_value(spark, few_hot_rows):
    """95% of a hot key have one start and one position: slices are cut inside it, and results stay the same."""
    limit = few_hot_rows
    rows = spark.range(1_000).select(
        F.lit(1).alias("k"), F.when(F.col("id") < 950, 100).otherwise(F.col("id")).alias("start"), (F.col("id") % 300 + 100).alias("end"), "id"
    )
    prepared = ordered(rows.withColumn("_tie", F.xxhash64("id")), ["k"], ["start", "_tie"])
    sizes = [r["count"] for r in prepared.df.groupBy("_slice").count().collect()]
    assert len(sizes) >= 1_000 / limit and max(sizes) <= limit
    a, b = rows.filter("id % 9 = 0"), rows.filter("id % 50 = 1").withColumnRenamed("id", "other")
    met = joins.interval_overlap(a, b, "start", "end", ["k"])
    plain = [
        (x.id, y.other) for x in a.collect() for y in b.collect()
        if max(x.start, y.start) <= min(x.end, y.end)
    ]
    assert sorted((r.id_a, r.other_b) for r in met.collect()) == sorted(plain)
    probes = rows.select("k", F.col("start").alias("at"), F.col("id").alias("probe"))
    points = spark.createDataFrame([(1, 99, "x"), (1, 100, "y"), (1, 100, "z"), (1, 960, "w"), (1, 1_300, "far")], "k int, at long, name string")
    near = joins.nearest_each_side(probes, points, ["k"], "at", 200, "name").collect()
    assert len(near) == 1_000
    for r in near:
        want = ("x", None) if r.at == 100 else (None if r.at <= 960 else "w", "w" if r.at < 960 else None)
        if r.at > 960:
            want = ("w", None)
        assert (r.before_label, r.after_label) == want, r


def test_circles_that_are_passed_several_times(spark):
    rows = [("a", i, v) for i, v in enumerate([5, None, 7, 1])] + [("b", 0, 3), ("c", 0, None), ("c", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for k in (-9, -8, -4, -3, -1, 1, 2, 4, 5, 11):
        found = {(r.k, r.i): r.circular for r in windows.circular_sum(df, ["k"], ["i"], "v", k).collect()}
        for key, i, _ in rows:
            circle = [v for name, _, v in rows if name == key]
            steps = range(1, k + 1) if k > 0 else range(k, 0)
            values = [circle[(i + s) % len(circle)] for s in steps]
            values = [v for v in values if v is not None]
            assert found[key, i] == (sum(values) if values else None), (key, i, k)


def test_doubled_source_keys_are_an_error(spark):
    target = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    once = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z"), (None, "w")], "k int, v string")
    merged = maintenance.synced_table(maintenance.full_sync(target, once, ["k"], ["v"]))
    # Both target rows of a key are updated; null keys match nothing.
    assert sorted(((r.k or 0, r.v) for r in merged.collect())) == [(0, "w"), (0, "z"), (1, "x"), (1, "x"), (3, "y")]
    twice = once.union(spark.createDataFrame([(3, "y")], "k int, v string"))
    for run in (
        lambda: maintenance.synced_table(maintenance.full_sync(target, twice, ["k"], ["v"])).count(),
        lambda: maintenance.full_sync(target, twice, ["k"], ["v"]).collect(),
        lambda: maintenance.status_update(target, twice, "k", ["v"]).collect(),
    ):
        with pytest.raises(Exception, match=r"several source rows for the key \(k\)"):
            run()
    updated = maintenance.status_update(target, once, "k", ["v"])
    assert sorted((r.k or 0, r.v) for r in updated.collect()) == [(0, "d"), (1, "x"), (1, "x"), (2, "c")]


def test_domains_of_any_size_and_tests_on_the_way(spark):
    dense = joins.dense_scaffold(spark.range(2), {"d": list(range(12_000)), "e": [1, 2]})
    assert dense.count() == 48_000 and dense.columns == ["id", "d", "e"]
    with pytest.raises(ValueError):
        joins.dense_scaffold(spark.range(2), {"d": spark.range(12_000)})
    with pytest.raises(ValueError):
        joins.dense_scaffold(spark.range(2), {"d": [1]}, when={"x": F.lit(True)})
    names = "abcde"
    chain = joins.dense_scaffold(
        spark.range(40), {n: list(range(40)) for n in names},
        when={n: F.col(n) == F.col("id" if n == "a" else names[names.index(n) - 1]) + 1 for n in names},
    )
    assert sorted(tuple(r) for r in chain.collect()) == [tuple(range(i, i + 6)) for i in range(35)]
    # Each test stands below the next domain in the plan, so rows stay few on the way.
    text = chain._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert re.search(r"Generate(.|\n)*Filter(.|\n)*Generate(.|\n)*Filter(.|\n)*Generate", text)


def test_documents_that_give_no_row_are_rejects(spark):
    rows = [
        (1, '{"Servers": [{"ServerName": "s", "Databases": [{"Name": "n"}]}]}'), (2, '{"Servers": [{"ServerName"'), (3, "no json"),
        (4, None), (5, "{}"), (6, '{"Servers": []}'), (7, '{"Servers": [{"Databases": []}, {"Databases": [{"Name": "m"}]}]}'),
        (8, ""), (9, '{"Servers": 5}'),
    ]
    df = spark.createDataFrame(rows, "id int, config string")
    flat = {r.id for r in fleet.deploy_plan(df, ["x"], keep=["id"]).collect()}
    rejects = {r.id: (r.config, r.reason) for r in fleet.deploy_rejects(df, keep=["id"]).collect()}
    assert flat == {1, 7} and set(rejects) == {2, 3, 4, 5, 6, 8, 9}
    assert rejects[2] == (rows[1][1], "malformed") and rejects[3][1] == rejects[9][1] == "malformed"
    assert rejects[4][1] == "missing" and rejects[5][1] == rejects[6][1] == "no items"


def test_all_recipients_are_told(spark):
    failures = spark.createDataFrame([("s", "d", "broken")], "server_name string, database_name string, error_message string")
    schema = "key_code string, key_description string, key_value string"
    two = spark.createDataFrame([("mail", "x", "b@x"), ("mail", "x", "a@x"), ("mail", "y", "c@x"), ("mail", "x", None)], schema)
    assert fleet.alert_rows(failures, two, "x").first().recipients == "a@x;b@x"
    assert fleet.alert_rows(failures, two, "z").first().recipients is None


def test_two_cells_at_one_place_are_an_error(spark):
    schema = "r int, pos int, value int"
    once = spark.createDataFrame([(0, 0, 5), (1, 0, 3), (0, 1, None), (7, 1, 9), (7, 1, 9)], schema)
    lines = {r.pos: (r.row_0, r.row_1, r.sorted_values) for r in reshape.transpose(once, "r", "pos", "value", [0, 1]).collect()}
    assert lines == {0: (5, 3, [3, 5]), 1: (None, None, [])}
    with pytest.raises(Exception, match="several cells in row 0 at position 1"):
        reshape.transpose(once.union(spark.createDataFrame([(0, 1, 2)], schema)), "r", "pos", "value", [0, 1]).collect()


def test_skewed_join_of_rows_with_maps(spark, few_hot_rows):
    left = spark.range(200).select(F.lit(1).alias("k"), F.create_map(F.lit("a"), "id").alias("m"), "id")
    right = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert skew_join(left, right, ["k"]).count() == 200


def test_pivot_counts_reports_unlisted_values(spark):
    df = spark.createDataFrame([(1, "a"), (1, "x"), (1, None), (2, "b")], "k int, item string")
    assert [tuple(r) for r in aggregates.pivot_counts(df, "k", "item", ["b", "a"], other="rest").collect()] == [(1, 1, 0, 2), (2, 0, 1, 0)]
