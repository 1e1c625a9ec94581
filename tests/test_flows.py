"""Operators put together the way a fleet uses them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rowkeeper import schemas
from rowkeeper.operators import filters, maintenance, ordering
from rowkeeper.plans import fleet
from rowkeeper.session import workspace
from rowkeeper.sources import readers, writers
from rowkeeper.sources.versions import read_table

AS_OF = "2024-01-31 12:00:00"


def at(hour, day=31):
    return dt.datetime(2024, 1, day, hour)


def test_queue_round(spark):
    """Choose a job per server, look up its rule, judge its attempts, write back status, rules, log and alerts."""
    queue = spark.createDataFrame([
        # id, server, database, type, rule, window start and end, delta, limit
        (1, "s1", "db1", "D", "FULL", at(1), at(23), 50, 2), (2, "s1", "db2", "L", "NONE", at(2), at(23), 10, 2),
        (3, "s2", "db3", "D", "FULL", at(1), at(12), 5, 2), (4, "s3", "db4", "I", "FULL", at(3), at(20), 5, 2),
        (5, "s3", "db5", "I", "FULL", at(3), at(20), 1, 2),
    ], "id bigint, server_name string, database_name string, backup_type string, backup_rule string, "
       "current_window_start timestamp_ntz, current_window_end timestamp_ntz, backup_delta int, max_failure_count int")
    queue = queue.withColumns({"status": F.lit("queued"), "is_selected": F.lit(0)})
    rules = spark.createDataFrame([("FULL", "full text")], "backup_rule string, rule_text string")

    booked = ordering.next_in_queue(
        queue, ["current_window_start", "backup_delta", "id"], F.col("backup_type") == "L", ["server_name"]
    )
    assert {r.id for r in booked.collect()} == {2, 3, 5}  # the log job first, though job 1 waits longer

    ruled = {r.id: (r.rule_text, r.no_backup_rule) for r in fleet.rule_or_default(booked, rules, "default").collect()}
    assert ruled == {2: ("default", 1), 3: ("full text", 0), 5: ("full text", 0)}

    attempts = spark.createDataFrame(
        [(2, 1, False), (2, 2, True), (5, 1, False), (5, 2, False)], "job_id bigint, attempt int, ok boolean"
    )
    outcome = fleet.job_outcome(booked.withColumnRenamed("id", "job_id"), attempts, AS_OF)
    # Job 2 fails once and then works; job 3 has a window that ends now; job 5 reaches its limit.
    assert {r.job_id: r.status for r in outcome.collect()} == {2: "Completed", 3: "out_of_window", 5: "max_failure"}

    changes = outcome.select(F.col("job_id").alias("id"), "status", F.lit(0).alias("is_selected"))
    after = maintenance.status_update(queue, changes, "id", ["status", "is_selected"])
    assert {r.id: r.status for r in after.collect()} == {
        1: "queued", 2: "Completed", 3: "out_of_window", 4: "queued", 5: "max_failure"
    }

    failed = after.filter("status = 'max_failure'")
    policies = spark.createDataFrame(
        [("db5", "I", "FULL", "Enabled"), ("db5", "D", "FULL", "Enabled"), ("db4", "I", "FULL", None)],
        "database_name string, backup_type string, backup_rule string, status string",
    )
    off = maintenance.disable_rules(policies, failed, ["database_name", "backup_type", "backup_rule"])
    assert {(r.database_name, r.backup_type): r.status for r in off.collect()} == {
        ("db5", "I"): "Disabled", ("db5", "D"): "Enabled", ("db4", "I"): None
    }

    codes = readers.inline_rows(spark, schemas.OUTCOME_CODES, "outcome string, error_number int")
    logged = writers.command_log(after.filter("status <> 'queued'").select(
        "id", "database_name", F.lit("run").alias("command"), F.lit("fleet").alias("command_type"),
        filters.moment(AS_OF).alias("start_time"), filters.moment(AS_OF).alias("end_time"),
        F.when(F.col("status") == "Completed", "ok").otherwise(F.col("status")).alias("outcome"),
        F.lit(None).cast("string").alias("error_message"),
    ), "outcome", codes)
    assert [f.simpleString() for f in logged.schema] == [
        f.strip().replace(" ", ":", 1) for f in schemas.COMMAND_LOG.split(",")
    ]
    assert {r.id: r.error_number for r in logged.collect()} == {2: 0, 3: 231, 5: 222}

    recipients = spark.createDataFrame(
        [("mail", "general_notification", "a@x.com"), ("mail", "other", "b@x.com")],
        "key_code string, key_description string, key_value string",
    )
    alerts = fleet.alert_rows(
        failed.withColumn("error_message", F.lit("limit reached")), recipients, "general_notification"
    ).collect()
    assert [(r.recipients, r.subject, r.body) for r in alerts] == [
        ("a@x.com", "Error detected for s3", "Database db5: limit reached")
    ]


def test_config_sync_of_all_targets_at_once(spark):
    central = spark.createDataFrame(
        [("s1", "LP", "log priority", "1"), ("s1", "mail", "ops", "a@x.com"), ("s2", "LP", "log priority", "0")],
        schemas.METADATA,
    )
    held = spark.createDataFrame(
        [("s1", "LP", "log priority", "0"), ("s1", "old", "gone", "x"), ("s3", "LP", "log priority", "1")], schemas.METADATA
    )
    merged = maintenance.full_sync_composite(
        held, central, ["server_name", "key_code"], ["key_description", "key_value"]
    )
    path = workspace(spark, "sync")
    maintenance.split_by_target(maintenance.synced_table(merged), "server_name", path)
    copy = maintenance.target_copy(spark, path, "server_name", "s1").select("key_code", "key_value")
    assert {tuple(r) for r in copy.collect()} == {("LP", "1"), ("mail", "a@x.com")}
    assert maintenance.target_copy(spark, path, "server_name", "s3").count() == 0

    # A later sync of one target leaves the others alone.
    changed = central.filter("server_name = 's2'").withColumn("key_value", F.lit("7"))
    writers.replace_table(changed, path, "server_name")
    assert read_table(spark, path).groupBy("server_name").count().count() == 2
    assert maintenance.target_copy(spark, path, "server_name", "s2").first().key_value == "7"


def test_replace_from_its_own_rows(spark):
    path = workspace(spark, "own")
    writers.replace_table(spark.range(100), path)
    writers.replace_table(read_table(spark, path).filter("id >= 40"), path)
    writers.replace_table(read_table(spark, path).filter("id < 90"), path)
    assert sorted(r.id for r in read_table(spark, path).collect()) == list(range(40, 90))


def test_replace_that_breaks_keeps_the_old_rows(spark):
    path = workspace(spark, "broken")
    writers.replace_table(spark.range(100), path)
    held = read_table(spark, path)
    broken = held.select(F.when(F.col("id") == 77, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="half way"):
        writers.replace_table(broken, path)
    assert sorted(r.id for r in read_table(spark, path).collect()) == list(range(100))


def test_partitions_replaced_from_their_own_rows(spark):
    path = workspace(spark, "own_parts")
    writers.replace_table(spark.range(60).withColumn("p", F.col("id") % 3), path, "p")
    writers.replace_table(read_table(spark, path).filter("p = 1 AND id < 30"), path, "p")
    counts = {r.p: r["count"] for r in read_table(spark, path).groupBy("p").count().collect()}
    assert counts == {0: 20, 1: 10, 2: 20}


def test_null_fields_keep_their_place(spark):
    df = spark.createDataFrame([("a", None, "c", None)], "x string, y int, z string, body string")
    assert [r.line for r in writers.delimited_lines(df, ["x", "y", "z"], body="body").collect()] == ["a ; ;c ;" + " " * 40]


def test_archive_over_three_runs(spark):
    """Collect, collect again, and collect after everything of one server has aged out."""
    def sets(rows):
        whole = [(*row[:5], row[4], row[5], "FULL") for row in rows]
        return spark.createDataFrame(whole, schemas.BACKUP_SET)

    old = dt.datetime(2022, 1, 31, 12)  # exactly two years
    first = [(1, 1, "s1", "a", old, "D"), (2, 2, "s1", "a", at(1), "L"), (1, 3, "s2", "b", old, "D")]
    media = spark.createDataFrame([(i, f"dev{i}") for i in range(1, 9)] + [(2, "dev2b")], schemas.MEDIA_FAMILY)
    archive = spark.createDataFrame([], "id int, backup_set_id bigint, server_name string, database_name string, physical_device_name "
                                        "string, backup_start_date timestamp_ntz, backup_finish_date timestamp_ntz, type string, "
                                        "recovery_model string")
    once = fleet.backup_archive(archive, sets(first), media, AS_OF)
    assert {(r.server_name, r.backup_set_id, r.physical_device_name) for r in once.collect()} == {
        ("s1", 2, "dev2"), ("s1", 2, "dev2b")
    }
    marks = maintenance.advance_marks(
        spark.createDataFrame([], "server_name string, mark bigint"), sets(first), "server_name", "backup_set_id"
    )
    second = sets(first + [(3, 4, "s1", "a", at(2), "L"), (2, 5, "s2", "b", at(3), "D")])
    twice = fleet.backup_archive(once, second, media, AS_OF, marks=marks)
    assert sorted((r.server_name, r.backup_set_id) for r in twice.collect()) == [
        ("s1", 2), ("s1", 2), ("s1", 3), ("s2", 2)
    ]


def test_personal_data_in_the_session_catalog(spark):
    rows = [("x", True, "m")]
    spark.createDataFrame(rows, "FirstName string, has_email boolean, Gender string").createOrReplaceTempView("people")
    spark.createDataFrame(rows, "firstName string, active boolean, other string").createOrReplaceTempView("log")
    catalog = readers.session_catalog(spark, "local")
    found = fleet.pii_columns(
        catalog, schemas.PII_NAME_PATTERNS, AS_OF, exclude_databases=schemas.SYSTEM_DATABASES, exclude_types=["boolean"]
    ).filter("object_name in ('people', 'log')")
    assert {(r.object_name, r.column_name) for r in found.collect()} == {
        ("people", "FirstName"), ("people", "Gender"), ("log", "firstName")
    }
    for view in ("people", "log"):
        spark.catalog.dropTempView(view)


def test_housekeeping_round(spark, tmp_path):
    """List files, match them with history by path, choose the ones to delete and log what happened."""
    from rowkeeper.operators.joins import inventory_match
    from rowkeeper.operators.windows import retention_candidates

    kinds = ["D", "L", "D", "I", "D", "L"]
    (tmp_path / "sub").mkdir()
    for i, kind in enumerate(kinds):
        (tmp_path / "sub" / f"Set{i}{kind}.bak").write_text("x" * (i + 1))
    (tmp_path / "stray.txt").write_text("no history")
    files = readers.file_inventory(spark, str(tmp_path))
    assert files.count() == 7
    history = spark.createDataFrame(
        [("s", "db", i, kind, at(i + 1), f"{tmp_path}/SUB/set{i}{kind}.BAK") for i, kind in enumerate(kinds)],
        "server_name string, database_name string, id int, dbtype string, backup_finish_date timestamp_ntz, full_name string",
    )
    matched = inventory_match(files, history, "full_name")
    assert matched.count() == 6
    due = retention_candidates(
        matched, ["server_name", "database_name"], "backup_finish_date", "id", "dbtype", "D", ["D", "I", "L"], keep=1
    )
    results = spark.createDataFrame([(0, "access denied")], "id int, error_message string")
    log = fleet.delete_outcomes(due, results, "id", schemas.FILE_DELETED, AS_OF).collect()
    assert {(r.id, r.row_num, r.full_sets, r.delete_status, r.time_stamp) for r in log} == {
        (2, 2, 2, 7, AS_OF), (1, 2, 2, 7, AS_OF), (0, 3, 3, 2, AS_OF)
    }


def test_stored_archive_over_runs_that_break(spark, monkeypatch):
    """New rows are added, old months go, and a run that broke between rows and marks is made good by the next."""
    from rowkeeper.plans import stored
    from rowkeeper.sources.versions import current, publish

    def sets(rows):
        return spark.createDataFrame([(*row[:5], row[4], row[5], "FULL") for row in rows], schemas.BACKUP_SET)

    def held(path):
        return sorted((r.server_name, r.backup_set_id) for r in fleet.stored_archive(spark, path).collect())

    media = spark.createDataFrame([(i, f"dev{i}") for i in range(1, 20)], schemas.MEDIA_FAMILY)
    servers = spark.createDataFrame([("s1",), ("s2",)], "server_name string")
    first = [
        (1, 1, "s1", "a", dt.datetime(2021, 5, 1), "D"), (2, 2, "s1", "a", dt.datetime(2022, 1, 31, 11), "D"),
        (3, 3, "s1", "a", dt.datetime(2022, 1, 31, 13), "D"), (1, 4, "s2", "b", at(1), "D"), (2, 5, "s2", "b", None, "D"),
        (7, 6, "s3", "c", at(1), "D"),
    ]
    path = workspace(spark, "archive")
    fleet.collect_archive(spark, path, sets(first), media, servers, AS_OF)
    assert held(path) == [("s1", 3), ("s2", 1), ("s2", 2)]  # The server that is not listed is not collected.
    second = first + [(4, 7, "s1", "a", at(2), "L"), (3, 8, "s2", "b", at(3), "L"), (4, 9, "s2", "b", at(4), "L")]
    before = current(spark, path)

    def publish_rows_only(df, at, *rest, **kwargs):
        if at.endswith(".marks"):
            raise OSError("broken")
        return publish(df, at, *rest, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(stored, "publish", publish_rows_only)
        with pytest.raises(OSError):
            fleet.collect_archive(spark, path, sets(second), media, servers, AS_OF)
    want = [("s1", 3), ("s1", 4), ("s2", 1), ("s2", 2), ("s2", 3), ("s2", 4)]
    for _ in range(2):
        fleet.collect_archive(spark, path, sets(second), media, servers, AS_OF)
        assert held(path) == want
    # Only the new rows and the month of the limit were written.
    kept = [f for f in before.folders if not f.endswith("month=2022-01")]
    assert kept and set(kept) <= set(current(spark, path).folders)
    # Two years later all that is left has no time; the marks hold, so nothing returns.
    fleet.collect_archive(spark, path, sets(second), media, servers, "2026-02-01 00:00:00")
    assert held(path) == [("s2", 2)]
    fleet.collect_archive(spark, path, sets(second), media, servers, "2026-02-01 00:00:00")
    assert held(path) == [("s2", 2)]


def test_messages_of_integrity_checks(spark):
    runs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "run_id int, server_name string")
    findings = spark.createDataFrame(
        [(1, 8989, "lost page"), (1, 2570, "bad value"), (1, 8989, "other page"), (3, 2570, "bad value"), (4, 8989, None)],
        "run_id int, error int, message_text string",
    )
    log = fleet.integrity_log(findings, runs, first_id=11)
    assert sorted((r.id, r.run_id, r.error_number) for r in log.collect()) == [
        (11, 1, 2570), (12, 1, 8989), (13, 1, 8989), (14, 2, 0), (15, 3, 2570), (16, 4, 8989)
    ]
    told = {r.run_id: (r.n_findings, r.message) for r in fleet.integrity_messages(log).collect()}
    assert told == {
        1: (3, "Error Message: lost page; For More information - SELECT * FROM a.command_log WHERE id IN (11,12,13)"),
        2: (0, "7"), 3: (1, None), 4: (1, None),
    }
