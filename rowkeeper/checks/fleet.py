from __future__ import annotations

from pyspark.sql import functions as F

from rowkeeper.checks.registry import EVENTS_AS_OF, ORDERS_AS_OF, TABLES, check
from rowkeeper.checks.sources import CATALOG_SQL, DEPLOY_ROWS, POLICY_ROWS, POLICY_SQL, deploy_documents
from rowkeeper.operators.filters import moment
from rowkeeper.plans import fleet
from rowkeeper.plans.ordered import ordered
from rowkeeper.schemas import DEPLOY_ACTIONS, FILE_DELETED, PII_NAME_PATTERNS
from rowkeeper.session import workspace, written
from rowkeeper.sources.readers import column_profile, inline_rows
from rowkeeper.sources.versions import read_table
from rowkeeper.sources.writers import append_table


def text(col):
    return F.col(col).cast("string")


def policies(t):
    """One policy row per user and event type."""
    rules = inline_rows(t.spark, POLICY_ROWS, "backup_type string, backup_interval_minutes int")
    pairs = t.events.select("user_id", F.col("event_type").alias("backup_type")).distinct()
    return pairs.join(rules, "backup_type").select(
        F.lit("local").alias("server_name"), text("user_id").alias("database_name"), "backup_type",
        F.concat(F.lit("rule_"), "backup_type").alias("backup_rule"), F.lit("store").alias("backup_location"),
        F.lit("Enabled").alias("status"), "backup_interval_minutes",
    )


def history(t):
    return t.events.select(
        F.lit("local").alias("server_name"), text("user_id").alias("database_name"), F.col("event_type").alias("type"),
        F.col("ts").alias("backup_start_date"), F.col("event_id").alias("media_set_id"),
    )


def media(t):
    """Large sets are striped over two devices."""
    stripes = F.when(F.col("value") > 80, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    striped = t.events.select(F.col("event_id").alias("media_set_id"), F.explode(stripes).alias("stripe"), "user_id")
    return striped.select(
        "media_set_id", F.concat(F.lit("dev_"), text("user_id"), F.lit("_"), "stripe").alias("physical_device_name")
    )


SNAPSHOT_SQL = f"""
SELECT 'local' AS server_name, CAST(user_id AS VARCHAR) AS database_name, event_type AS backup_type,
  'rule_' || event_type AS backup_rule, 'store' AS backup_location, 'Enabled' AS local_status, "interval",
  backup_delta, greatest(backup_delta - "interval", 0) AS delay, last_backup,
  'dev_' || user_id || '_' || stripe AS physical_device_name, TIMESTAMP '{EVENTS_AS_OF}' AS "timestamp"
FROM (
  SELECT l.user_id, l.event_type, p."interval", l.last_backup, m.stripe,
    date_diff('minute', l.last_backup, TIMESTAMP '{EVENTS_AS_OF}') AS backup_delta
  FROM (SELECT user_id, event_type, max(ts) AS last_backup, max(event_id) AS set_id FROM events GROUP BY ALL) l
  JOIN {POLICY_SQL} AS p(event_type, "interval") ON p.event_type = l.event_type
  JOIN (SELECT event_id, 'a' AS stripe FROM events UNION ALL SELECT event_id, 'b' FROM events WHERE value > 80) m
    ON m.event_id = l.set_id)
"""


@check("freshness_snapshot", SNAPSHOT_SQL)
def freshness_snapshot(t):
    return fleet.freshness_snapshot(policies(t), history(t), media(t), EVENTS_AS_OF)


# The tables at hand have few columns of these names, so more patterns are looked for.
NAME_PATTERNS = [*PII_NAME_PATTERNS, "%name%", "%ACCT%", "%user%id%", "%text%"]


@check("pii_columns", f"""
SELECT '{EVENTS_AS_OF}' AS collection_date, 'local' AS server_name, 'main' AS db_name, 'USER_TABLE' AS object_type,
  table_name AS object_name, column_name, type_name
FROM ({CATALOG_SQL})
WHERE n_values > 0 AND type_name <> 'int' AND ({" OR ".join(f"column_name ILIKE '{p}'" for p in NAME_PATTERNS)})
""")
def pii_columns(t):
    """Columns that hold values under such names; what holds them is read from the rows."""
    columns = column_profile({name: getattr(t, name) for name in TABLES}).filter("n_values > 0")
    catalog = columns.select(
        F.lit("local").alias("server_name"), F.lit("main").alias("db_name"), F.lit("USER_TABLE").alias("object_type"),
        F.col("table_name").alias("object_name"), "column_name", "type_name",
    )
    secondaries = inline_rows(t.spark, [("far", "main")], "server_name string, db_name string")
    return fleet.pii_columns(catalog, NAME_PATTERNS, EVENTS_AS_OF, ["tempdb"], ["int"], secondaries)


# Kinds of personal data and their patterns.
PII_PATTERNS = {
    "email": "[A-Za-z0-9_-]@[A-Za-z0-9]",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": "[0-9]{3}[-. ][0-9]{4}",
    "long_digits": "[0-9]{9,}",
}


@check("pii_content", "WITH d AS (SELECT lang, text FROM documents) " + " UNION ALL ".join(
    f"""SELECT lang, '{kind}' AS kind, count(*) AS n_rows, count(*) FILTER (n > 0) AS n_rows_hit,
  CAST(sum(n) AS BIGINT) AS n_hits, round(count(*) FILTER (n > 0) / count(*), 6) AS hit_rate
FROM (SELECT lang, len(regexp_extract_all(text, '{pattern}')) AS n FROM d) GROUP BY lang"""
    for kind, pattern in PII_PATTERNS.items()
))
def pii_content(t):
    return fleet.pii_content(t.documents, "text", PII_PATTERNS, ["lang"])


ARCHIVE_SQL = f"""
WITH s AS (SELECT o_orderkey AS backup_set_id, o_orderpriority AS server_name, CAST(o_custkey AS VARCHAR) AS database_name,
    o_orderdate AS backup_start_date, o_orderdate + INTERVAL 1 HOUR AS backup_finish_date, o_orderstatus AS type,
    CASE WHEN o_orderkey % 2 = 0 THEN 'FULL' ELSE 'SIMPLE' END AS recovery_model FROM orders),
  m AS (SELECT DISTINCT l_orderkey AS backup_set_id, 'dev_' || l_suppkey AS physical_device_name FROM lineitem),
  a AS (SELECT s.*, physical_device_name FROM s JOIN m ON s.backup_set_id = m.backup_set_id
    WHERE server_name <> '1-URGENT' AND {{first}}),
  k AS (SELECT server_name, max(backup_set_id) AS mark FROM a GROUP BY server_name),
  r AS (SELECT * FROM a UNION ALL SELECT s.*, physical_device_name FROM s JOIN m ON s.backup_set_id = m.backup_set_id
    LEFT JOIN k ON k.server_name = s.server_name WHERE s.backup_set_id > coalesce(k.mark, 0))
SELECT 1 AS id, * FROM r WHERE backup_start_date > TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 2 YEAR
"""


def backup_sets(t):
    return t.orders.select(
        F.col("o_orderkey").alias("backup_set_id"), F.col("o_orderkey").alias("media_set_id"),
        F.col("o_orderpriority").alias("server_name"), text("o_custkey").alias("database_name"),
        F.col("o_orderdate").alias("backup_start_date"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("backup_finish_date"), F.col("o_orderstatus").alias("type"),
        F.when(F.col("o_orderkey") % 2 == 0, "FULL").otherwise("SIMPLE").alias("recovery_model"),
    )


def backup_devices(t):
    return written(t.lineitem.select(
        F.col("l_orderkey").alias("media_set_id"),
        F.concat(F.lit("dev_"), text("l_suppkey")).alias("physical_device_name"),
    ).distinct(), "devices")


@check("backup_archive", ARCHIVE_SQL.format(first="backup_start_date < TIMESTAMP '1998-01-01'"))
def backup_archive(t):
    sets, devices = backup_sets(t), backup_devices(t)
    first = sets.filter(
        (F.col("server_name") != "1-URGENT") & (F.col("backup_start_date") < moment("1998-01-01"))
    )
    archive = written(fleet.archive_rows(first, devices), "archive")
    return fleet.backup_archive(archive, sets, devices, ORDERS_AS_OF)


@check("collect_archive", ARCHIVE_SQL.format(first="s.backup_set_id BETWEEN 1 AND (SELECT max(o_orderkey) // 2 FROM orders)"))
def collect_archive(t):
    """Two runs on the stored archive; the first server joins with the second run, and a third run finds nothing new."""
    sets, devices = backup_sets(t), backup_devices(t)
    servers = sets.select("server_name").distinct()
    path = workspace(t.spark, "stored_archive")
    half = sets.filter(F.col("backup_set_id") <= t.orders.select(F.expr("max(o_orderkey) div 2")).scalar())
    others = servers.filter(F.col("server_name") != "1-URGENT")
    fleet.collect_archive(t.spark, path, half, devices, others, "1992-01-01 00:00:00")
    for _ in range(2):
        fleet.collect_archive(t.spark, path, sets, devices, servers, ORDERS_AS_OF)
    return fleet.stored_archive(t.spark, path)


RULES = [("ECONOMY", "FULL"), ("STANDARD", "DIFF"), ("PROMO", "LOG"), ("SMALL", "COPY")]


@check("rule_or_default", """
SELECT p_partkey, p_type AS backup_rule, coalesce(rule_text, 'DEFAULT') AS rule_text,
  CASE WHEN rule_text IS NULL THEN 1 ELSE 0 END AS no_backup_rule
FROM part LEFT JOIN (VALUES ('ECONOMY', 'FULL'), ('STANDARD', 'DIFF'), ('PROMO', 'LOG'), ('SMALL', 'COPY'))
  AS r(backup_rule, rule_text) ON p_type = backup_rule
""")
def rule_or_default(t):
    jobs = t.part.select("p_partkey", F.col("p_type").alias("backup_rule"))
    return fleet.rule_or_default(jobs, inline_rows(t.spark, RULES, "backup_rule string, rule_text string"), "DEFAULT")


def jobs(t):
    """One job per user; its window ends 31 days after the first event, its limit follows from the user's events."""
    return t.events.groupBy(F.col("user_id").alias("job_id")).agg(
        (F.min("ts") + F.make_dt_interval(F.lit(30), F.lit(1))).alias("current_window_end"),
        F.when(F.max("value") > 250, 1).when(F.max("value") > 200, 2).otherwise(40).alias("max_failure_count"),
    )


@check("job_outcome", f"""
WITH j AS (SELECT user_id AS job_id, min(ts) + INTERVAL 30 DAY + INTERVAL 1 HOUR AS window_end,
    CASE WHEN max(value) > 250 THEN 1 WHEN max(value) > 200 THEN 2 ELSE 40 END AS lim FROM events GROUP BY user_id),
  a AS (SELECT user_id AS job_id, event_type = 'purchase' AS ok,
    row_number() OVER (PARTITION BY user_id ORDER BY ts) AS attempt FROM events
    WHERE event_type IN ('error', 'purchase') AND value > 20),
  s AS (SELECT job_id, min(attempt) FILTER (ok) AS first_ok, count(*) FILTER (NOT ok) AS failed FROM a GROUP BY job_id),
  r AS (SELECT j.job_id, window_end, lim, first_ok, least(lim, coalesce(first_ok - 1, failed, 0)) AS failures
    FROM j LEFT JOIN s ON s.job_id = j.job_id),
  o AS (SELECT job_id, CASE WHEN window_end <= TIMESTAMP '{EVENTS_AS_OF}' THEN 'out_of_window'
    WHEN first_ok <= lim THEN 'Completed' WHEN failures >= lim THEN 'max_failure'
    WHEN failures > 0 THEN 'fail ' || failures ELSE 'queued' END AS status, failures FROM r)
SELECT job_id, status, CASE WHEN status = 'out_of_window' THEN 0 ELSE failures END AS failures,
  CASE status WHEN 'max_failure' THEN 222 WHEN 'out_of_window' THEN 231 ELSE 0 END AS error_number FROM o
""")
def job_outcome(t):
    tried = t.events.filter(F.col("event_type").isin("error", "purchase") & (F.col("value") > 20)).select(
        F.col("user_id").alias("job_id"), "ts", (F.col("event_type") == "purchase").alias("ok")
    )
    attempts = ordered(tried, ["job_id"], ["ts"]).add(position="attempt").rows()
    return fleet.job_outcome(jobs(t), attempts, EVENTS_AS_OF)


@check("alert_rows", f"""
SELECT 'ops@example.com;lead@example.com' AS recipients, 'Error detected for ' || server_name AS subject,
  'Database ' || database_name || ': ' || backup_type || ' is late by ' || delay || ' minutes' AS body, 'High' AS importance
FROM ({SNAPSHOT_SQL}) WHERE delay > 0
""")
def alert_rows(t):
    late = freshness_snapshot(t).filter(F.col("delay") > 0).select(
        "server_name", "database_name",
        F.format_string("%s is late by %d minutes", "backup_type", "delay").alias("error_message"),
    )
    recipients = inline_rows(t.spark, [
        ("mail", "general_notification", "ops@example.com;lead@example.com"), ("mail", "other", "nobody@example.com"),
        ("LP", "log priority", "1"),
    ], "key_code string, key_description string, key_value string")
    return fleet.alert_rows(late, recipients, "general_notification")


@check("delete_outcomes", f"""
SELECT event_id, event_type AS dbtype, CASE WHEN event_type = 'error' AND value > 50 THEN props END AS error_message,
  CASE WHEN event_type = 'error' AND value > 50 THEN 2 ELSE 7 END AS delete_status, '{EVENTS_AS_OF}' AS time_stamp
FROM events
""")
def delete_outcomes(t):
    candidates = t.events.select("event_id", F.col("event_type").alias("dbtype"))
    results = t.events.filter((F.col("event_type") == "error") & (F.col("value") > 50)).select(
        "event_id", F.col("props").alias("error_message")
    )
    return fleet.delete_outcomes(candidates, results, "event_id", FILE_DELETED, EVENTS_AS_OF)


@check("delete_candidates", """
SELECT DISTINCT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS restore_database_name, n_name AS restore_server_name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 100000 AND o_orderdate < TIMESTAMP '1999-01-01'
  AND n_regionkey IN (1, 2, 3)
""")
def delete_candidates(t):
    status = F.when(F.col("o_orderstatus") == "F", 7).when(F.col("o_orderstatus") == "P", -1).otherwise(0)
    placed = t.orders.join(
        t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey"
    ).join(t.nation, "n_nationkey")
    restores = placed.select(
        F.col("o_orderkey").alias("id"), text("o_custkey").alias("restore_database_name"),
        F.col("n_name").alias("restore_server_name"), status.alias("dbcc_status"),
        F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("delete_after_check"),
        F.when(F.col("o_orderdate") < moment("1999-01-01"), 0).otherwise(1).alias("delete_status"),
    )
    servers = t.nation.select(
        F.col("n_name").alias("server_name"),
        F.when(F.col("n_regionkey").isin(1, 2, 3), 1).otherwise(0).alias("is_restore_target"),
    )
    return fleet.delete_candidates(restores, servers)


@check("integrity_collect", """
WITH l AS (SELECT CAST(user_id AS VARCHAR) AS server_name, event_id AS own_id, event_type AS command_type, ts AS start_time
    FROM events WHERE event_type = 'error'),
  d AS (SELECT * FROM l WHERE start_time < TIMESTAMP '2024-01-12'),
  k AS (SELECT server_name, max(own_id) AS mark FROM d GROUP BY server_name)
SELECT * FROM d UNION ALL
SELECT l.* FROM l LEFT JOIN k ON k.server_name = l.server_name WHERE own_id > coalesce(mark, 0)
""")
def integrity_collect(t):
    logs = t.events.select(
        text("user_id").alias("server_name"), F.col("event_id").alias("own_id"),
        F.col("event_type").alias("command_type"), F.col("ts").alias("start_time"),
    )
    details = logs.filter((F.col("command_type") == "error") & (F.col("start_time") < moment("2024-01-12")))
    for _ in range(2):  # The second collection finds nothing new.
        path = workspace(t.spark, "details")
        append_table(fleet.integrity_collect(details, logs, "error"), path)
        details = t.spark.read.schema(logs.schema).parquet(path)
    return details


INTEGRITY_SQL = """
SELECT CAST(user_id AS VARCHAR) AS server_name, event_id AS own_id, event_type AS command_type, ts AS start_time
FROM events WHERE event_type = 'error' AND user_id % 7 <> 0 AND event_id > 0
"""


@check("collect_integrity", INTEGRITY_SQL)
def collect_integrity(t):
    """Three runs on stored details, over half of the log and twice over all of it; some servers are not listed."""
    logs = t.events.select(
        text("user_id").alias("server_name"), F.col("event_id").alias("own_id"),
        F.col("event_type").alias("command_type"), F.col("ts").alias("start_time"),
    )
    servers = t.events.filter(F.col("user_id") % 7 != 0).select(text("user_id").alias("server_name")).distinct()
    path = workspace(t.spark, "stored_details")
    half = logs.filter(F.col("own_id") <= t.events.select(F.expr("max(event_id) div 2")).scalar())
    for rows in (half, logs, logs):
        fleet.collect_integrity(t.spark, path, rows, servers, "error")
    return read_table(t.spark, path)


@check("integrity_messages", """
WITH f AS (SELECT user_id AS run_id, CASE WHEN event_id % 3 = 0 THEN 8989 ELSE 2570 END AS error,
    CASE WHEN event_id % 5 <> 0 THEN props END AS text FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-10'),
  r AS (SELECT DISTINCT user_id AS run_id, 'srv' || user_id % 3 AS server_name FROM events),
  l AS (SELECT r.run_id, server_name, coalesce(error, 0) AS error, text,
    row_number() OVER (ORDER BY r.run_id, coalesce(error, 0), text NULLS FIRST) + 99 AS id FROM r LEFT JOIN f ON r.run_id = f.run_id)
SELECT run_id, count(*) FILTER (error <> 0) AS n_findings,
  CASE WHEN count(*) FILTER (error <> 0) = 0 THEN '7'
    ELSE 'Error Message: ' || (list(text ORDER BY id) FILTER (error = 8989))[1] || '; For More information - SELECT * FROM ' || server_name
      || '.command_log WHERE id IN (' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (error <> 0) || ')' END AS message
FROM l GROUP BY run_id, server_name
""")
def integrity_messages(t):
    failed = t.events.filter((F.col("event_type") == "error") & (F.col("ts") < moment("2024-01-10")))
    findings = failed.select(
        F.col("user_id").alias("run_id"), F.when(F.col("event_id") % 3 == 0, 8989).otherwise(2570).alias("error"),
        F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("message_text"),
    )
    runs = t.events.select(
        F.col("user_id").alias("run_id"), F.concat(F.lit("srv"), (F.col("user_id") % 3).cast("string")).alias("server_name")
    ).distinct()
    return fleet.integrity_messages(fleet.integrity_log(findings, runs, first_id=100))


@check("disk_history", f"""
SELECT 'nation_' || c_nationkey AS computer_name, c_name AS name, 1000000 AS size_bytes,
  CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) * 100 ELSE 0 END AS free_bytes,
  round((CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) * 100 ELSE 0 END) / 10000, 2) AS percent_free,
  TIMESTAMP '{EVENTS_AS_OF}' AS time
FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION ALL
SELECT 'nation_' || c_nationkey, c_name, 500000, 0, 0.0, TIMESTAMP '2024-01-01' FROM customer WHERE c_mktsegment = 'MACHINERY'
""")
def disk_history(t):
    drive = [F.concat(F.lit("nation_"), text("c_nationkey")).alias("computer_name"), F.col("c_name").alias("name")]
    free = F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("bigint") * 100).otherwise(0)
    old = t.customer.select(
        *drive, F.lit(500_000).alias("size_bytes"), F.lit(0).cast("bigint").alias("free_bytes"),
        F.lit(0.0).alias("percent_free"), moment("2024-01-01").alias("time"),
    )
    probe = t.customer.filter(F.col("c_mktsegment") != "MACHINERY").select(
        *drive, F.lit(1_000_000).alias("size_bytes"), free.alias("free_bytes")
    )
    return fleet.latest_disks(fleet.disk_history(old, probe, EVENTS_AS_OF))


@check("audit_sample", """
SELECT * FROM (SELECT server_name, id, name, row_number() OVER (PARTITION BY server_name ORDER BY name, id) AS position FROM (
  SELECT 'customer' AS server_name, c_custkey AS id, c_name AS name FROM customer
  UNION ALL SELECT 'part', p_partkey, p_name FROM part))
WHERE position <= 5
""")
def audit_sample(t):
    frames = {
        "customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "part": t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
    }
    return fleet.audit_sample(frames, ["supplier"], 5, ["name", "id"])


@check("deploy_plan", f"""
WITH r AS ({DEPLOY_ROWS}),
  z AS (SELECT 'east-' || c_nationkey AS "ServerName", c_name AS "Name", c_acctbal * 10 AS size_mb FROM customer)
SELECT c_custkey, r."Environment", r."TargetServer", r."ServerName", r."Name", r."NewName", r."Action", size_mb,
  CASE WHEN "Action" NOT IN ('DetachAttach', 'BackupRestore') THEN 'invalid_action'
    WHEN size_mb > 35000 AND "Action" = 'BackupRestore' THEN 'too_big' END AS reject_reason,
  '-Action ' || "Action" || ' -SourceServer ' || r."ServerName" || ' -TargetServer ' || "TargetServer" || ' -Database '
    || r."Name" || ' -NewDBName ' || "NewName" AS command_line
FROM r LEFT JOIN z ON z."ServerName" = r."ServerName" AND z."Name" = r."Name"
""")
def deploy_plan(t):
    sizes = t.customer.select(
        F.concat(F.lit("east-"), text("c_nationkey")).alias("ServerName"), F.col("c_name").alias("Name"),
        (F.col("c_acctbal") * 10).alias("size_mb"),
    )
    return fleet.deploy_plan(deploy_documents(t.customer), DEPLOY_ACTIONS, sizes=sizes, keep=["c_custkey"])


@check("table_clone", """
SELECT 'full' AS mode, count(*) AS n_rows, CAST(sum(o_custkey) AS BIGINT) AS sum_custkey, 6 AS n_columns FROM orders
UNION ALL SELECT 'schema', 0, NULL, 6
""")
def table_clone(t):
    size = fleet.folder_size_mb(t.spark, t.path("orders"))
    summaries = []
    for mode in ("schema", "full"):
        path = workspace(t.spark, f"clone-{mode}")
        fleet.table_clone(t.orders, path, mode, size)
        copy = read_table(t.spark, path)
        summaries.append(copy.agg(
            F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n_rows"), F.sum("o_custkey").alias("sum_custkey"),
            F.lit(len(copy.columns)).alias("n_columns"),
        ))
    return summaries[0].unionByName(summaries[1])


def shifts(t):
    mentor = F.when(F.col("c_acctbal") < 0, "").when(F.col("c_acctbal") <= 9000, F.upper("c_name"))
    return t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        F.lower("c_name").alias("win_login"), mentor.alias("mentor_login"), F.col("c_name").alias("full_name")
    )


@check("oncall_sync", """
SELECT lower(c_name) AS login, CASE WHEN c_mktsegment = 'BUILDING' THEN 'add' ELSE 'remove' END AS action
FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')
""")
def oncall_sync(t):
    group = t.customer.filter(F.col("c_mktsegment").isin("MACHINERY", "AUTOMOBILE")).select(
        F.col("c_name").alias("login")
    )
    return fleet.oncall_sync(shifts(t), group)


@check("oncall_notice", """
WITH p AS (SELECT c_name, lower(c_name) || '@example.com' AS email,
  (row_number() OVER (ORDER BY c_name) - 1) // 1000 AS part FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT 'names' AS kind, part, count(*) AS n_items, string_agg(c_name, ', ' ORDER BY c_name) AS items FROM p GROUP BY part
UNION ALL SELECT 'emails', part, count(*), string_agg(email, ';' ORDER BY c_name) FROM p GROUP BY part
""")
def oncall_notice(t):
    directory = t.customer.select(
        F.col("c_name").alias("full_name"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email")
    )
    return fleet.oncall_notice(shifts(t), directory)


@check("access_report", """
SELECT p_brand || '/' || p_partkey AS repo, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS login,
  unnest(['admin', 'read']) AS role FROM part
""")
def access_report(t):
    words = F.split("p_name", " ")
    people = F.array(
        F.struct(words[0].alias("login"), F.lit("admin").alias("role")),
        F.struct(words[1].alias("login"), F.lit("read").alias("role")),
    )
    parents = t.part.select(F.concat("p_brand", F.lit("/"), text("p_partkey")).alias("repo"), people.alias("people"))
    path = workspace(t.spark, "access")
    report = fleet.access_report(parents, "repo", "people", path)
    return t.spark.read.schema(report.schema).option("header", True).csv(path)
