"""Edge cases and properties of filters, maintenance, sinks and fleet compositions."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rowkeeper import schemas
from rowkeeper.operators import aggregates, filters, maintenance, ordering, reshape
from rowkeeper.plans import fleet
from rowkeeper.session import workspace
from rowkeeper.sources import readers, writers
from rowkeeper.sources.versions import read_table
from rowkeeper.streaming.collect import stream_collect

AS_OF = "2024-01-31 00:00:00"


def ts(text):
    return dt.datetime.fromisoformat(text)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_schemas_are_valid_ddl(spark):
    from pyspark.sql.types import StructType

    widths = {"FINDINGS": 23, "AUDIT_LOG": 18, "POLICY": 16, "QUEUE": 17, "DELETE_LOG": 12, "BACKUP_SET": 8}
    for name, width in widths.items():
        assert len(StructType.fromDDL(getattr(schemas, name)).fields) == width


def test_window_that_ends_now_is_closed(spark):
    df = spark.createDataFrame([(ts("2024-01-31"),), (ts("2024-01-31 00:00:01"),)], "e timestamp_ntz")
    assert [r.window_state for r in filters.open_window(df, "e", AS_OF).collect()] == ["out_of_window", "open"]


def test_recent_rows_is_strict_and_purge_inclusive(spark):
    df = spark.createDataFrame(
        [(1, ts("2022-01-31")), (2, ts("2022-01-31 00:00:01")), (3, None)], "i int, t timestamp_ntz"
    )
    assert {r.i for r in maintenance.retention_purge(df, "t", 2, AS_OF).collect()} == {2, 3}
    assert {r.i for r in filters.recent_rows(df, "t", 730, AS_OF).collect()} == {2}


def test_null_in_list_is_refused(spark):
    with pytest.raises(ValueError):
        filters.in_not_in(spark.range(1), "id", exclude=[1, None])


def test_validate_plan_cap_is_strict(spark):
    rows = [("BackupRestore", 35000.0), ("BackupRestore", 35000.1), ("DetachAttach", 99999.0), ("Drop", 1.0), (None, 1.0)]
    df = filters.validate_plan(
        spark.createDataFrame(rows, "a string, mb double"), "a", schemas.DEPLOY_ACTIONS, "mb",
        capped=schemas.CAPPED_ACTIONS,
    )
    assert [r.reject_reason for r in df.collect()] == [None, "too_big", None, "invalid_action", "invalid_action"]


def test_full_sync_properties(spark):
    target = spark.createDataFrame(
        [("a", "x", 1, "on"), ("b", "x", 2, "off"), ("c", "x", 3, "on")], "k string, r string, v int, status string"
    )
    source = spark.createDataFrame([("a", "x", None), ("c", "x", 30), ("d", "x", 4)], "k string, r string, v int")
    merged = maintenance.full_sync_composite(target, source, ["k", "r"], ["v"])
    assert as_set(merged) == {
        ("a", "x", None, "on", "update"), ("b", "x", 2, "off", "delete"), ("c", "x", 30, "on", "update"),
        ("d", "x", 4, None, "insert"),
    }
    table = maintenance.synced_table(merged)
    assert as_set(table.drop("status")) == as_set(source)
    again = maintenance.full_sync_composite(table, source, ["k", "r"], ["v"])
    assert {r.action for r in again.collect()} == {"update"}
    assert as_set(maintenance.synced_table(again)) == as_set(table)


def test_membership_diff_gives_wanted(spark):
    current = spark.createDataFrame([("Ann",), ("BOB",), ("bob",), (None,)], "n string")
    wanted = spark.createDataFrame([("bob",), ("Cid",), ("cid",)], "n string")
    diff = {r.n: r.action for r in reshape.membership_diff(current, wanted, "n").collect()}
    assert diff == {"ann": "remove", "cid": "add"}


def test_marks_never_fall_after_purge(spark):
    first = spark.createDataFrame([("s", 1), ("s", 2), ("t", 7)], "src string, id bigint")
    marks = maintenance.advance_marks(spark.createDataFrame([], "src string, mark bigint"), first, "src", "id")
    purged = first.filter("src = 't'")
    batch = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("u", 1)], "src string, id bigint")
    loaded = maintenance.incremental_append(purged, batch, marks, "src", "id")
    assert as_set(loaded) == {("t", 7), ("s", 3), ("u", 1)}
    kept = maintenance.advance_marks(marks, batch.limit(0), "src", "id")
    assert as_set(kept) == {("s", 2), ("t", 7)}


def test_two_incremental_loads_equal_one(spark):
    rows = [(f"s{i % 3}", i) for i in range(1, 40)]
    whole = spark.createDataFrame(rows, "src string, id bigint")
    early, none = whole.filter("id < 20"), spark.createDataFrame([], "src string, mark bigint")
    marks = maintenance.advance_marks(none, early, "src", "id")
    assert as_set(maintenance.incremental_append(early, whole, marks, "src", "id")) == set(rows)


def test_staged_insert_takes_one_row_per_key(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    staging = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c"), (3, None)], "k int, v string")
    assert as_set(writers.staged_insert(target, staging, ["k"])) == {(2, "c"), (3, None)}


def test_check_summary_cases(spark):
    targets = spark.createDataFrame([("clean",), ("coded",), ("uncoded",)], "db string")
    found = spark.createDataFrame(
        [("coded", 2, 8989, "second"), ("coded", 1, 8989, "first"), ("coded", 0, 1, "other"), ("uncoded", 1, 5, "x")],
        "db string, id int, error int, message_text string",
    )
    assert as_set(aggregates.check_summary(targets, found, "db")) == {
        ("clean", 0, "ok", None), ("coded", 3, "failed", "first"), ("uncoded", 1, "failed", None)
    }


def test_snapshot_never_backed_up_and_two_devices(spark):
    policy = spark.createDataFrame(
        [("s", "db", "D", "r", "loc", "Enabled", 60), ("s", "never", "D", "r", "loc", "Enabled", 60)],
        "server_name string, database_name string, backup_type string, backup_rule string, backup_location string, "
        "status string, backup_interval_minutes int",
    )
    history = spark.createDataFrame(
        [("s", "db", "D", ts("2024-01-30 23:30:59"), 4), ("s", "db", "D", ts("2024-01-29"), 9)],
        "server_name string, database_name string, type string, backup_start_date timestamp_ntz, media_set_id bigint",
    )
    media = spark.createDataFrame([(9, "a"), (9, "b"), (4, "c")], schemas.MEDIA_FAMILY)
    rows = fleet.freshness_snapshot(policy, history, media, AS_OF).collect()
    # The latest time and the largest set come from different rows.
    assert {(r.database_name, r.backup_delta, r.delay, r.physical_device_name) for r in rows} == {
        ("db", 30, 0, "a"), ("db", 30, 0, "b")
    }


def test_job_outcome_cases(spark):
    late, early = ts("2024-02-01"), ts("2024-01-31")
    jobs = spark.createDataFrame(
        [(1, late, 3), (2, late, 3), (3, late, 3), (4, late, 3), (5, early, 3), (6, late, 0), (7, late, 3)],
        "job_id bigint, current_window_end timestamp_ntz, max_failure_count int",
    )
    tries = {1: [1], 2: [0, 0, 1], 3: [0, 0, 0], 4: [0], 5: [1], 6: [0], 7: []}
    attempts = spark.createDataFrame(
        [(job, n, bool(ok)) for job, oks in tries.items() for n, ok in enumerate(oks, 1)],
        "job_id bigint, attempt int, ok boolean",
    )
    got = {r.job_id: (r.status, r.error_number) for r in fleet.job_outcome(jobs, attempts, AS_OF).collect()}
    assert got == {
        1: ("Completed", 0), 2: ("Completed", 0), 3: ("max_failure", 222), 4: ("fail 1", 0), 5: ("out_of_window", 231),
        6: ("invalid_limit", 0), 7: ("queued", 0),
    }


def test_one_row_shift_and_blank_mentor(spark):
    shift = spark.createDataFrame([("Ann", "", "Ann A")], schemas.SHIFTS)
    group = spark.createDataFrame([("ANN",), ("zed",)], "login string")
    assert as_set(fleet.oncall_sync(shift, group)) == {("zed", "remove")}
    mentored = spark.createDataFrame([("Ann", "Bo", "Ann A")], schemas.SHIFTS)
    assert as_set(fleet.oncall_sync(mentored, group)) == {("zed", "remove"), ("bo", "add")}


def test_notice_text(spark):
    shift = spark.createDataFrame([("a", None, "Ann"), ("b", None, "Bo")], schemas.SHIFTS)
    directory = spark.createDataFrame([("Ann", "a@x.com"), ("Bo", "b@x.com")], "full_name string, email string")
    got = {r.kind: r["items"] for r in fleet.oncall_notice(shift, directory).collect()}
    assert got == {"names": "Ann, Bo", "emails": "a@x.com;b@x.com"}


def test_deploy_plan_keeps_duplicates_and_repeated_servers(spark):
    text = (
        '{"Environment": "E", "TargetServer": "T", "Servers": ['
        '{"ServerName": "s", "Databases": [{"Name": "a", "NewName": "n", "Action": "BackupRestore"},'
        ' {"Name": "b", "NewName": "n", "Action": "Drop"}]},'
        '{"ServerName": "s", "Databases": [{"Name": "a", "NewName": "m", "Action": "DetachAttach"}]},'
        '{"ServerName": "none", "Databases": []}]}'
    )
    sizes = spark.createDataFrame([("s", "a", 40000.0)], "ServerName string, Name string, size_mb double")
    plan = fleet.deploy_plan(spark.createDataFrame([(text,)], "config string"), schemas.DEPLOY_ACTIONS, sizes=sizes)
    assert {(r.Name, r.NewName, r.reject_reason) for r in plan.collect()} == {
        ("a", "n", "too_big"), ("b", "n", "invalid_action"), ("a", "m", None)
    }
    line = plan.filter("NewName = 'm'").first().command_line
    assert line == "-Action DetachAttach -SourceServer s -TargetServer T -Database a -NewDBName m"


def test_table_clone_refuses_above_a_cap_and_unknown(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        fleet.table_clone(df, workspace(spark, "no"), "full", size_mb=35_001, cap=35_000)
    with pytest.raises(ValueError):
        fleet.table_clone(df, workspace(spark, "no"), "other")
    path = workspace(spark, "large")
    fleet.table_clone(df, path, "full", size_mb=35_001)
    assert read_table(spark, path).count() == 3


def test_inline_rows_of_any_size(spark):
    for n in (10, 10_001):
        rows = readers.inline_rows(spark, [(i,) for i in range(n)], "i int")
        text = spark.range(20_000).join(rows, F.col("id") == F.col("i"))._jdf.queryExecution().optimizedPlan().toString()
        assert rows.count() == n and ("strategy=broadcast" in text) == (n == 10)


def test_one_row_cross_needs_one_row(spark):
    from rowkeeper.operators.joins import one_row_cross

    left = spark.range(2)
    assert one_row_cross(left, spark.range(0).withColumnRenamed("id", "x")).count() == 0
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        one_row_cross(left, spark.range(2).withColumnRenamed("id", "x")).collect()


def test_preferred_first_then_any(spark):
    rows = [(1, "D", 1), (2, "L", 5), (3, "D", 0)]
    df = spark.createDataFrame(rows, "id int, type string, w int")
    assert ordering.next_in_queue(df, ["w", "id"], F.col("type") == "L").first().id == 2
    assert ordering.next_in_queue(df.filter("type = 'D'"), ["w", "id"], F.col("type") == "L").first().id == 3


def test_retention_counts_fulls_at_or_after(spark):
    from rowkeeper.operators.windows import retention_candidates

    rows = [(i, t, ts(f"2024-01-{i:02d}")) for i, t in enumerate(["D", "L", "D", "I", "D", "L"], 1)]
    df = spark.createDataFrame(rows, "id int, type string, t timestamp_ntz").withColumn("db", F.lit("x"))
    got = retention_candidates(df, ["db"], "t", "id", "type", "D", ["D", "I", "L"], keep=1).collect()
    assert {(r.id, r.row_num, r.full_sets) for r in got} == {(3, 2, 2), (2, 2, 2), (1, 3, 3)}


def test_long_lists_come_in_parts(spark):
    df = spark.range(25).select(F.lit("k").alias("k"), "id")
    got = aggregates.id_list(df, "k", "id", per_part=10).orderBy("part").collect()
    assert [r.n_items for r in got] == [10, 10, 5]
    assert ",".join(r["items"] for r in got) == ",".join(str(i) for i in range(25))


def test_stream_picks_up_only_new_files(spark):
    root = workspace(spark, "stream")
    schema = "id bigint, at timestamp_ntz"

    def land(first, last):
        rows = spark.range(first, last).select("id", F.lit(AS_OF).cast("timestamp_ntz").alias("at"))
        rows.write.mode("append").parquet(f"{root}/in")

    def run():
        stream_collect(spark, f"{root}/in", schema, f"{root}/out", f"{root}/ckpt").awaitTermination()
        return sorted(r.id for r in spark.read.schema(schema).parquet(f"{root}/out").collect())

    land(0, 5)
    assert run() == list(range(5))
    land(5, 8)
    assert run() == list(range(8))
    assert run() == list(range(8))


def test_stream_leaves_out_resent_rows_and_keeps_late_ones(spark):
    root = workspace(spark, "resent")
    schema = "id bigint, at timestamp_ntz"
    for first, last, day in ((0, 5, "2024-01-31"), (3, 8, "2020-01-01")):
        rows = spark.range(first, last).select("id", F.lit(day).cast("timestamp_ntz").alias("at"))
        rows.write.mode("append").parquet(f"{root}/in")
        stream_collect(spark, f"{root}/in", schema, f"{root}/out", f"{root}/ckpt", keys=["id"]).awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{root}/out").collect()
    assert sorted((r.id, r.at.year) for r in rows) == [(i, 2024 if i < 5 else 2020) for i in range(8)]


def test_json_files_become_a_plan(spark, tmp_path):
    for name, action in (("one", "DetachAttach"), ("two", "Rename")):
        (tmp_path / f"{name}.config").write_text(
            '{\n "Environment": "E",\n "TargetServer": "T",\n "Servers": [\n  {"ServerName": "s", "Databases": [\n'
            f'   {{"Name": "{name}", "NewName": "n", "Action": "{action}"}}\n  ]}}\n ]\n}}\n'
        )
    plan = fleet.deploy_plan(readers.json_documents(spark, str(tmp_path)), schemas.DEPLOY_ACTIONS)
    assert {(r.Name, r.reject_reason) for r in plan.collect()} == {("one", None), ("two", "invalid_action")}


def test_access_report_from_json_lists(spark, tmp_path):
    answers = [
        ("repo1", '[{"login": "ann", "role_name": "admin", "id": 1}, {"login": "bo", "role_name": "read"}]'),
        ("repo2", '[{"login": "ann", "role_name": "write"}]'), ("repo3", "[]"),
    ]
    parsed = readers.json_list(
        spark.createDataFrame(answers, "Repo string, answer string"), "answer", "login string, role_name string", "people"
    )
    fleet.access_report(parsed, "Repo", "people", str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert as_set(back) == {("repo1", "ann", "admin"), ("repo1", "bo", "read"), ("repo2", "ann", "write")}
    assert back.columns == ["Repo", "login", "role_name"]


def test_merged_requests_since(spark):
    text = (
        '[{"title": "a", "headRefName": "x", "mergedAt": "2024-01-01T00:00:00Z", "state": "MERGED"},'
        ' {"title": "b", "headRefName": "y", "mergedAt": "2024-01-02T10:00:00Z", "state": "MERGED"}]'
    )
    listed = readers.json_list(spark.createDataFrame([(text,)], "t string"), "t", schemas.MERGED, "requests")
    rows = listed.select(F.inline("requests"))
    got = filters.merged_since(rows, "mergedAt", "2024-01-01", ["title", "headRefName", "mergedAt", "state"])
    assert [r.title for r in got.collect()] == ["b"]


def test_workspace_is_new_and_follows_the_session(spark):
    assert workspace(spark, "a") != workspace(spark, "a")

    def session(master, **conf):
        context = SimpleNamespace(master=master, getConf=lambda: conf)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))

    shared = session("yarn", **{"spark.checkpoint.dir": "hdfs://x/shared/"})
    assert workspace(shared, "a").startswith("hdfs://x/shared/a-")
    with pytest.raises(ValueError):
        workspace(session("yarn"), "a")


@pytest.mark.parametrize("n", [3, 1001])
def test_sample_per_source_large_and_small(spark, few_hot_rows, n):
    df = spark.range(3000).select((F.col("id") % 2).alias("s"), "id")
    got = ordering.sample_per_source(df, "s", ["id"], n)
    assert got.count() == 2 * n and got.agg(F.max("id")).first()[0] == 2 * n - 1


def test_large_k_takes_the_sliced_path(spark, few_hot_rows):
    df = spark.range(3000).select((F.col("id") % 2).alias("s"), "id")
    assert as_set(ordering.kth_row(df, ["id"], 1200, ["s"])) == {(0, 2398), (1, 2399)}


def test_incremental_read_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = filters.recent_rows(events, "ts", 10, AS_OF).select("event_id")._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "GreaterThan(ts,2024-01-21T00:00)" in text and "value" not in text.split("ReadSchema")[1]


def test_inline_rows_of_all_kinds(spark):
    assert readers.inline_rows(spark, [], "a string, n int").count() == 0
    rows = [("x", None, 1.5, True, ts(AS_OF), [1, 2]), (None, 2, None, None, None, None)]
    df = readers.inline_rows(spark, rows, "a string, n bigint, f double, b boolean, t timestamp_ntz, l array<int>")
    assert [tuple(r) for r in df.collect()] == rows


def test_custom_order_without_reference_keeps_the_tie_order(spark):
    df = spark.createDataFrame([("b", 2), ("a", 3), ("c", 1)], "v string, i int")
    assert [r.v for r in ordering.custom_order(df, "v", [], ["i"]).orderBy("rank").collect()] == ["c", "b", "a"]


def test_empty_inputs(spark):
    from rowkeeper.operators import joins, windows
    from rowkeeper.plans.concordance import concordance_counts

    none = spark.createDataFrame([], "k string, i int, v int")
    assert windows.run_changes(none, ["k"], ["i"], "v", 0).count() == 0
    assert windows.circular_sum(none, ["k"], ["i"], "v", 2).count() == 0
    assert windows.coverage_rank(none, "v").count() == 0
    assert concordance_counts(none, ["k"], ["i"], "v").count() == 0
    assert joins.interval_overlap(none, none, "i", "v", ["k"]).count() == 0
    assert aggregates.common_multiset(none, "k", "v").count() == 0
    assert aggregates.covered_length(spark.createDataFrame([], "w string"), "w", "a").first().covered_length == 0
    assert {r.is_sorted for r in aggregates.sortedness_check(none, ["k"], ["i"], ["v"]).collect()} == {True}


def test_nulls_in_values(spark):
    from rowkeeper.operators import windows

    rows = [("u", 0, None), ("u", 1, None), ("u", 2, 5), ("u", 3, None)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    assert windows.run_changes(df, ["k"], ["i"], "v", 0).first().n_changes == 3  # 0, null, null, 5, null
    found = aggregates.sortedness_check(df, ["k"], ["i"], ["v"]).first()
    assert found.is_sorted
    assert [r.circular for r in windows.circular_sum(df, ["k"], ["i"], "v", 1).orderBy("i").collect()] == [
        None, 5, None, None
    ]
