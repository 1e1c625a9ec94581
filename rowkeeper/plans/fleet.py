"""Compositions for fleet data operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeeper.functions.scalars import minutes_between, plus, stamp
from rowkeeper.operators.aggregates import high_water_mark, joined_parts, latest_per_key, latest_row_per_key
from rowkeeper.operators.filters import in_not_in, moment, name_patterns, non_blank, validate_plan
from rowkeeper.operators.joins import directory_lookup, semi_join
from rowkeeper.operators.maintenance import incremental_rows, retention_purge
from rowkeeper.operators.ordering import sample_per_source
from rowkeeper.operators.reshape import membership_diff, nested_explode_report, unpivot_columns
from rowkeeper.plans.ordered import ranked
from rowkeeper.plans.skew import skew_join
from rowkeeper.plans.stored import collect_new, month_of, purge_months
from rowkeeper.schemas import (
    ACTION_FAILED, ALLOCATION_ERROR, ARCHIVE_YEARS, CAPPED_ACTIONS, CHECK_OK, DEPLOY_CONFIG, DRY_RUN_LINE, MAX_COPY_MB,
)
from rowkeeper.sources.readers import collect_union, file_inventory, json_flatten, json_rejects
from rowkeeper.sources.versions import read_table
from rowkeeper.sources.writers import csv_export, replace_table, staged_insert


def freshness_snapshot(policy: DataFrame, history: DataFrame, media: DataFrame, as_of: str) -> DataFrame:
    """Per policy row: last backup, minutes since, delay beyond the interval, device.

    The history shrinks to one row per (server, database, type) before it meets anything else. Items that were never
    backed up have no row, as the inner join drops them.
    """
    keys = ["server_name", "database_name", "type"]
    latest = latest_per_key(history, keys, "backup_start_date", "media_set_id")
    devices = latest.withColumnRenamed("max_media_set_id", "media_set_id").join(
        media.select("media_set_id", "physical_device_name"), "media_set_id", "inner"
    )
    now = moment(as_of)
    last = F.coalesce("max_backup_start_date", plus(now, months=-1))
    joined = policy.withColumn("type", F.col("backup_type")).join(devices, keys, "inner")
    measured = joined.withColumn("backup_delta", minutes_between(last, now))
    return measured.select(
        "server_name", "database_name", "backup_type", "backup_rule", "backup_location",
        F.col("status").alias("local_status"), F.col("backup_interval_minutes").alias("interval"), "backup_delta",
        F.greatest(F.col("backup_delta") - F.col("backup_interval_minutes"), F.lit(0)).alias("delay"),
        F.col("max_backup_start_date").alias("last_backup"), "physical_device_name", now.alias("timestamp"),
    )


def pii_columns(
    catalog: DataFrame, patterns: list[str], as_of: str, exclude_databases: list[str] | None = None,
    exclude_types: list[str] | None = None, secondaries: DataFrame | None = None,
    object_types: list[str] | None = None,
) -> DataFrame:
    """Catalog columns whose names suggest personal data, stamped with the collection time.

    ``secondaries`` lists (server_name, db_name) of replicas that are not primary.
    """
    kept = in_not_in(catalog, "object_type", include=object_types or ["USER_TABLE", "VIEW"])
    kept = in_not_in(kept, "db_name", exclude=exclude_databases or [])
    kept = in_not_in(kept, "type_name", exclude=exclude_types or [])
    if secondaries is not None:
        kept = kept.join(secondaries, ["server_name", "db_name"], "left_anti")
    return name_patterns(kept, "column_name", patterns).select(
        F.lit(as_of).alias("collection_date"), "server_name", "db_name", "object_type", "object_name",
        "column_name", "type_name",
    )


def pii_content(df: DataFrame, text: str, patterns: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Per kind of personal data: rows looked at, rows with a hit, hits."""
    by = by or []
    hits = df.select(*by, *[F.regexp_count(F.col(text), F.lit(p)).alias(k) for k, p in patterns.items()])
    # Counting before the unpivot: one row per group reaches the shuffle.
    sums = [
        F.struct(
            F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(k) > 0).alias("n_rows_hit"),
            F.coalesce(F.sum(F.col(k).cast("bigint")), F.lit(0).cast("bigint")).alias("n_hits"),
        ).alias(k)
        for k in patterns
    ]
    report = hits.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*patterns)))
    return report.withColumn("hit_rate", F.round(F.col("n_rows_hit") / F.nullif("n_rows", F.lit(0)), 6))


ARCHIVE_COLUMNS = [
    "id", "backup_set_id", "server_name", "database_name", "physical_device_name", "backup_start_date", "backup_finish_date",
    "type", "recovery_model",
]


def archive_rows(sets: DataFrame, media: DataFrame) -> DataFrame:
    """Sets with their devices in the columns of the archive; ``id`` is 1, as the archive numbers its rows itself."""
    return skew_join(media, sets, ["media_set_id"]).withColumn("id", F.lit(1)).select(*ARCHIVE_COLUMNS)


def backup_archive(
    archive: DataFrame, sets: DataFrame, media: DataFrame, as_of: str, years: int = ARCHIVE_YEARS,
    marks: DataFrame | None = None, listed: bool = False,
) -> DataFrame:
    """The central archive after one collection: new sets per server, then retention.

    Only sets above the mark meet the media table. Give ``marks`` when they are kept as a table; with ``listed`` that table lists all
    servers and the scan starts at the least mark. ``collect_archive`` does the same on a stored archive and writes only new rows.
    """
    if marks is None:
        marks = high_water_mark(sets.select("server_name").distinct(), archive, "server_name", "backup_set_id")
    new = incremental_rows(sets, marks, "server_name", "backup_set_id", listed)
    return retention_purge(archive.unionByName(archive_rows(new, media)), "backup_start_date", years, as_of)


def collect_archive(
    spark: SparkSession, path: str, sets: DataFrame, media: DataFrame, servers: DataFrame, as_of: str, years: int = ARCHIVE_YEARS
) -> None:
    """One run of the archive on its stored table: sets of the listed servers above their marks are added, then old months go.

    The archive lies in folders by month of ``backup_start_date``; a run writes the new rows and the month of the limit, no others.
    """
    def shape(new: DataFrame) -> DataFrame:
        return archive_rows(new, media).withColumn("month", month_of(F.col("backup_start_date")))

    keys = ["server_name", "backup_set_id", "physical_device_name"]
    collect_new(spark, path, sets, servers, "server_name", "backup_set_id", keys, shape, "month")
    purge_months(spark, path, "month", "backup_start_date", years, as_of)


def stored_archive(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path).select(*ARCHIVE_COLUMNS)


def rule_or_default(jobs: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The rule text of each job; a job whose rule is not configured gets the default one and a flag."""
    return skew_join(jobs, rules.select("backup_rule", "rule_text"), ["backup_rule"], "left").withColumn(
        "no_backup_rule", F.when(F.col("rule_text").isNull(), 1).otherwise(0)
    ).withColumn("rule_text", F.coalesce("rule_text", F.lit(default)))


def job_outcome(jobs: DataFrame, attempts: DataFrame, as_of: str) -> DataFrame:
    """Final status of each job from its attempts, which are numbered from 1.

    Attempts stop at the first success or at the limit; a limit below 1 is reported, as it has no meaning.
    """
    tried = attempts.groupBy("job_id").agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("first_ok"),
        F.count_if(~F.col("ok")).alias("all_failures"),
    )
    limit = F.col("max_failure_count")
    joined = jobs.join(tried, "job_id", "left").withColumn(
        "failures",
        F.least(
            limit.cast("bigint"), F.coalesce(F.col("first_ok").cast("bigint") - 1, F.col("all_failures"), F.lit(0))
        ),
    )
    closed = F.col("current_window_end") <= moment(as_of)
    done = F.col("first_ok") <= limit
    status = (
        F.when(limit < 1, "invalid_limit")
        .when(closed, "out_of_window")
        .when(done, "Completed")
        .when(F.col("failures") >= limit, "max_failure")
        .when(F.col("failures") > 0, F.concat(F.lit("fail "), F.col("failures").cast("string")))
        .otherwise("queued")
    )
    code = F.when(F.col("status") == "max_failure", 222).when(F.col("status") == "out_of_window", 231).otherwise(0)
    return joined.select(
        "job_id", status.alias("status"),
        F.when(closed, F.lit(0).cast("bigint")).otherwise(F.col("failures")).alias("failures"),
    ).withColumn("error_number", code)


def alert_rows(failures: DataFrame, recipients: DataFrame, kind: str) -> DataFrame:
    """Message rows for failures: recipients by notification type (of several rows all, in order), subject and body."""
    to = recipients.filter((F.col("key_code") == "mail") & (F.col("key_description") == kind) & F.col("key_value").isNotNull())
    # A few rows of configuration.
    every = to.agg(F.nullif(F.array_join(F.array_sort(F.collect_set("key_value")), ";"), F.lit("")).alias("all"))
    return failures.select(
        every.scalar().alias("recipients"),
        F.format_string("Error detected for %s", "server_name").alias("subject"),
        F.format_string("Database %s: %s", "database_name", "error_message").alias("body"),
        F.lit("High").alias("importance"),
    )


def delete_outcomes(candidates: DataFrame, results: DataFrame, id: str, ok_code: int, as_of: str) -> DataFrame:
    """Log rows for attempted deletions: the ok code, or 2 with the error text."""
    told = results.select(id, "error_message")
    return candidates.join(told, id, "left").withColumns({
        "delete_status": F.when(F.col("error_message").isNotNull(), ACTION_FAILED).otherwise(ok_code),
        "time_stamp": stamp(moment(as_of)),
    })


def delete_candidates(restores: DataFrame, servers: DataFrame) -> DataFrame:
    """Restored databases that were checked, are marked for deletion, still exist and lie on an allowed server."""
    checked = in_not_in(restores, "dbcc_status", include=[-1, 7])
    due = checked.filter((F.col("delete_after_check") == 1) & (F.col("delete_status") == 0))
    allowed = servers.withColumnRenamed("server_name", "restore_server_name")
    return semi_join(due, allowed, ["restore_server_name"], F.col("is_restore_target") == 1).select(
        "id", "restore_database_name", "restore_server_name"
    ).distinct()


def integrity_collect(details: DataFrame, logs: DataFrame, kind: str) -> DataFrame:
    """Check-log details after one collection of rows of one kind above the mark of each server.

    The insert leaves out what the details already hold, so a repeated collection adds nothing.
    """
    wanted = logs.filter(F.col("command_type") == kind)
    marks = high_water_mark(wanted.select("server_name").distinct(), details, "server_name", "own_id")
    staging = incremental_rows(wanted, marks, "server_name", "own_id")
    return details.unionByName(staged_insert(details, staging, ["server_name", "own_id"]))


def collect_integrity(spark: SparkSession, path: str, logs: DataFrame, servers: DataFrame, kind: str) -> None:
    """``integrity_collect`` on stored details: adds the new rows of the listed servers and writes no others."""
    wanted = logs.filter(F.col("command_type") == kind)
    collect_new(spark, path, wanted, servers, "server_name", "own_id", ["server_name", "own_id"])


def integrity_log(findings: DataFrame, runs: DataFrame, first_id: int = 1) -> DataFrame:
    """Log rows of integrity checks: one per finding, and for a check without findings one with error 0 and no text.

    ``findings`` and ``runs`` share ``run_id``; a run has the columns of the log but for its findings. Rows are numbered from
    ``first_id`` by run, error and text.
    """
    found = findings.select("run_id", F.col("error").alias("error_number"), F.col("message_text").alias("error_message"))
    rows = runs.join(found, "run_id", "left").withColumn("error_number", F.coalesce("error_number", F.lit(0)))
    numbered = ranked(rows, ["run_id", "error_number", "error_message"], "id")
    return numbered.withColumn("id", F.col("id") + (first_id - 1))


def integrity_messages(log: DataFrame) -> DataFrame:
    """One message per check from its log rows: the check's result code when it found nothing, else the text of its allocation
    error and the ids of its log rows.

    A check that found other errors only, or an allocation error without a text, has a null message. Of several allocation
    errors the one with the lowest log id tells. A message is one value, so it holds all ids of its check; they are put
    together from parts (see ``joined_parts``), so a check with very many findings is not sorted by one task.
    """
    found = F.col("error_number") != 0
    told = log.groupBy("run_id", "server_name").agg(
        F.count_if(found).alias("n_findings"),
        F.min_by(F.struct(F.col("error_message").alias("text")), F.when(F.col("error_number") == ALLOCATION_ERROR, F.col("id"))).alias("_first"),
    )
    parts = joined_parts(log.filter(found).select("run_id", "id"), ["run_id"], "id", ["id"], ",")
    ids = parts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("part", "items"))).alias("_parts")).select(
        "run_id", F.array_join("_parts.items", ",").alias("_ids")
    )
    # The wording of the message.
    where = F.concat(F.lit("; For More information - SELECT * FROM "), "server_name", F.lit(".command_log WHERE id IN ("), "_ids", F.lit(")"))
    message = F.when(F.col("n_findings") == 0, F.lit(str(CHECK_OK))).otherwise(F.concat(F.lit("Error Message: "), F.col("_first.text"), where))
    return told.join(ids, "run_id", "left").select("run_id", "n_findings", message.alias("message"))


def disk_history(history: DataFrame, probe: DataFrame, as_of: str) -> DataFrame:
    """Capacity history with one more probe, stamped and with its free share."""
    stamped = probe.withColumn("time", moment(as_of)).withColumn(
        "percent_free", F.round(F.col("free_bytes") * 100.0 / F.nullif("size_bytes", F.lit(0)), 2)
    )
    return history.unionByName(stamped.select(*history.columns))


def latest_disks(history: DataFrame) -> DataFrame:
    return latest_row_per_key(history, ["computer_name", "name"], "time", "size_bytes")


def audit_sample(frames: dict[str, DataFrame], exclude: list[str], n: int, order: list[str]) -> DataFrame:
    """n rows from every source that is not excluded."""
    kept = {name: df for name, df in frames.items() if name not in exclude}
    return sample_per_source(collect_union(kept, "server_name"), "server_name", order, n)


def deploy_plan(
    config: DataFrame, allowed: list[str], cap: float = MAX_COPY_MB, sizes: DataFrame | None = None,
    col: str = "config", keep: list[str] | None = None,
) -> DataFrame:
    """Action rows of nested deployment documents with the reason for rejected ones and the dry-run line.

    ``sizes`` is (ServerName, Name, size_mb); full copies above the cap are rejected.
    """
    rows = json_flatten(config, col, DEPLOY_CONFIG, ["Servers", "Databases"], keep)
    if sizes is None:
        rows = rows.withColumn("size_mb", F.lit(None).cast("double"))
    else:
        rows = rows.join(sizes, ["ServerName", "Name"], "left")
    checked = validate_plan(rows, "Action", allowed, "size_mb", cap, CAPPED_ACTIONS)
    line = F.format_string(DRY_RUN_LINE, "Action", "ServerName", "TargetServer", "Name", "NewName")
    return checked.withColumn("command_line", line)


def deploy_rejects(config: DataFrame, col: str = "config", keep: list[str] | None = None) -> DataFrame:
    """The deployment documents that give no action row, with their text and the reason."""
    return json_rejects(config, col, DEPLOY_CONFIG, ["Servers", "Databases"], keep)


def folder_size_mb(spark: SparkSession, path: str) -> float:
    total = file_inventory(spark, path).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n")).first().n
    return total / 1_000_000


def table_clone(df: DataFrame, path: str, mode: str, size_mb: float = 0.0, cap: float | None = None) -> None:
    """Write an empty table of the same schema, or a full copy, unless ``size_mb`` is above a given ``cap``."""
    if mode == "schema":
        replace_table(df.limit(0), path)
    elif mode == "full":
        if cap is not None and size_mb > cap:
            raise ValueError(f"{size_mb} MB is too big for a full copy")
        replace_table(df, path)
    else:
        raise ValueError(f"unknown mode {mode}")


def shift_logins(shifts: DataFrame) -> DataFrame:
    """Logins of a shift, mentors too, without blanks; one row or many are treated alike."""
    return non_blank(unpivot_columns(shifts, ["win_login", "mentor_login"], "login"), "login")


def oncall_sync(shifts: DataFrame, group: DataFrame) -> DataFrame:
    """Who to add to and who to remove from the group so that it matches the shift."""
    return membership_diff(group, shift_logins(shifts), "login")


def oncall_notice(shifts: DataFrame, directory: DataFrame) -> DataFrame:
    """Names and addresses of the shift as message text: names with commas, addresses with semicolons."""
    named = directory_lookup(shifts.select("full_name"), directory, "full_name")
    whole = named.withColumn("notice", F.lit("shift"))
    names = joined_parts(whole, ["notice"], "full_name", ["full_name"], ", ").withColumn("kind", F.lit("names"))
    mails = joined_parts(whole, ["notice"], "email", ["full_name", "email"], ";").withColumn("kind", F.lit("emails"))
    return reduce(DataFrame.unionByName, [names, mails]).select("kind", "part", "n_items", "items")


def access_report(parents: DataFrame, parent: str, list_col: str, path: str) -> DataFrame:
    """Parent, login and role rows, written as CSV once for all parents."""
    report = nested_explode_report(parents, parent, list_col)
    csv_export(report, path)
    return report

