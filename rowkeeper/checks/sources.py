from __future__ import annotations

from pyspark.sql import functions as F

from rowkeeper.checks.registry import TABLES, check
from rowkeeper.operators.joins import dict_lookup
from rowkeeper.schemas import DEPLOY_CONFIG, OUTCOME_CODES
from rowkeeper.session import workspace
from rowkeeper.sources import readers, writers
from rowkeeper.sources.versions import read_table

PEOPLE = """
SELECT 'customer' AS source, c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal
FROM customer
UNION ALL
SELECT 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
"""


def people(t):
    """Customers and suppliers in one shape, by source."""
    def shape(df, p, key):
        return df.select(
            F.col(key).alias("key"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_nationkey").alias("nationkey"),
            F.col(f"{p}_acctbal").alias("acctbal"),
        )

    return {"customer": shape(t.customer, "c", "c_custkey"), "supplier": shape(t.supplier, "s", "s_suppkey")}


@check("collect_union", PEOPLE)
def collect_union(t):
    return readers.collect_union(people(t))


@check("collect_folders", PEOPLE)
def collect_folders(t):
    root = workspace(t.spark, "sources")
    for name, df in people(t).items():
        writers.append_table(df, f"{root}/source={name}")
    schema = "key bigint, name string, nationkey int, acctbal double, source string"
    return readers.collect_folders(t.spark, root, schema)


@check("source_list", "SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 0")
def source_list(t):
    return readers.source_list(t.supplier, "s_nationkey", F.col("s_acctbal") > 0)


@check("param_query", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000.0
""")
def param_query(t):
    return readers.param_query(
        t.spark,
        "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} "
        "WHERE o_orderstatus = :status AND o_totalprice > :min_price",
        {"status": "O", "min_price": 100000.0},
        orders=t.orders,
    )


CATALOG_SQL = f"""
WITH v AS ({" UNION ALL ".join(
    f"""SELECT '{name}' AS table_name, column_name, n_values, (SELECT count(*) FROM {name}) AS n_rows
  FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {name}) ON COLUMNS(*) INTO NAME column_name VALUE n_values)""" for name in TABLES)})
SELECT table_name, column_name,
  CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS type_name,
  CAST(ordinal_position AS BIGINT) AS ordinal, n_rows, n_values
FROM information_schema.columns JOIN v USING (table_name, column_name)
"""


@check("catalog_columns", CATALOG_SQL)
def catalog_columns(t):
    return readers.column_profile({name: getattr(t, name) for name in TABLES})


@check("file_inventory", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n_rows, true AS all_sized FROM {name}" for name in TABLES
))
def file_inventory(t):
    """The files of all tables, put together by table."""
    files = [readers.file_rows(getattr(t, name)).withColumn("table_name", F.lit(name)) for name in TABLES]
    whole = files[0]
    for more in files[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("table_name").agg(F.sum("n_rows").alias("n_rows"), F.every(F.col("size_bytes") > 0).alias("all_sized"))


def deploy_documents(customer):
    """One nested document per customer: two servers, the first with two databases."""
    def database(name, new, action):
        return F.struct(name.alias("Name"), new.alias("NewName"), action.alias("Action"))

    name, segment, nation = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    copy = F.lit("BackupRestore")
    other = F.when(F.col("c_acctbal") < 0, "Copy").otherwise("BackupRestore")
    first = F.array(
        database(name, F.concat(name, F.lit("_a")), copy), database(segment, segment, F.lit("DetachAttach")),
    )
    second = F.array(database(name, F.concat(name, F.lit("_b")), other))
    document = F.struct(
        segment.alias("Environment"),
        F.concat(F.lit("target-"), nation).alias("TargetServer"),
        F.array(
            F.struct(F.concat(F.lit("east-"), nation).alias("ServerName"), first.alias("Databases")),
            F.struct(F.concat(F.lit("west-"), nation).alias("ServerName"), second.alias("Databases")),
        ).alias("Servers"),
    )
    return customer.select("c_custkey", F.to_json(document).alias("config"))


DEPLOY_ROWS = """
SELECT c_custkey, c_mktsegment AS "Environment", 'target-' || c_nationkey AS "TargetServer",
  'east-' || c_nationkey AS "ServerName", c_name AS "Name", c_name || '_a' AS "NewName", 'BackupRestore' AS "Action"
FROM customer
UNION ALL
SELECT c_custkey, c_mktsegment, 'target-' || c_nationkey, 'east-' || c_nationkey, c_mktsegment, c_mktsegment,
  'DetachAttach' FROM customer
UNION ALL
SELECT c_custkey, c_mktsegment, 'target-' || c_nationkey, 'west-' || c_nationkey, c_name, c_name || '_b',
  CASE WHEN c_acctbal < 0 THEN 'Copy' ELSE 'BackupRestore' END FROM customer
"""


@check("json_flatten", DEPLOY_ROWS)
def json_flatten(t):
    documents = deploy_documents(t.customer)
    return readers.json_flatten(documents, "config", DEPLOY_CONFIG, ["Servers", "Databases"], ["c_custkey"])


@check("json_rejects", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'malformed' WHEN 2 THEN 'no items' ELSE 'missing' END AS reason,
  CASE o_orderkey % 4 WHEN 1 THEN '{"Environment": "' || o_orderpriority || '", "Servers": [{"Databases": [{"Name": "a"}'
    WHEN 2 THEN '{"Environment": "' || o_orderpriority || '", "Servers": [{"Databases": []}]}' END AS config
FROM orders WHERE o_orderkey % 4 <> 0
""")
def json_rejects(t):
    """Documents that are cut off, hold nothing or are missing."""
    def document(end):
        return F.concat(F.lit('{"Environment": "'), "o_orderpriority", F.lit(f'", "Servers": [{{"Databases": [{end}'))

    kind = F.col("o_orderkey") % 4
    config = (
        F.when(kind == 0, document('{"Name": "a"}]}]}')).when(kind == 1, document('{"Name": "a"}')).when(kind == 2, document("]}]}"))
    )
    documents = t.orders.select("o_orderkey", config.alias("config"))
    rejects = readers.json_rejects(documents, "config", DEPLOY_CONFIG, ["Servers", "Databases"], ["o_orderkey"])
    return rejects.select("o_orderkey", "reason", "config")


@check("json_field", """
SELECT event_type, count(*) AS n_events, CAST(sum(k) AS BIGINT) AS sum_k, round(avg(k), 6) AS avg_k
FROM (SELECT event_type, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events)
GROUP BY event_type
""")
def json_field(t):
    parsed = readers.json_field(t.events.select("event_type", "props"), "props", "k int", "p")
    k = F.col("p.k")
    return parsed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(k).alias("sum_k"), F.round(F.avg(k), 6).alias("avg_k")
    )


# Interval in minutes per event type.
POLICY_ROWS = [("click", 60), ("view", 120), ("purchase", 1440), ("signup", 2880), ("error", 30)]
POLICY_SQL = "(VALUES ('click', 60), ('view', 120), ('purchase', 1440), ('signup', 2880), ('error', 30))"


@check("inline_rows", f"""
SELECT e.event_type, p.interval_minutes, count(*) AS n_events
FROM events e JOIN {POLICY_SQL} AS p(event_type, interval_minutes) ON e.event_type = p.event_type
GROUP BY e.event_type, p.interval_minutes
""")
def inline_rows(t):
    policy = readers.inline_rows(t.spark, POLICY_ROWS, "event_type string, interval_minutes int")
    counted = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))
    return counted.join(policy, "event_type").select("event_type", "interval_minutes", "n_events")


@check("append_table", "SELECT * FROM orders")
def append_table(t):
    path = workspace(t.spark, "append")
    writers.append_table(t.orders.filter(F.col("o_orderstatus") == "F"), path)
    writers.append_table(t.orders.filter(F.col("o_orderstatus") != "F"), path)
    return t.spark.read.schema(t.orders.schema).parquet(path)


@check("replace_table", """
SELECT s_suppkey, s_name, s_nationkey, CASE WHEN n_regionkey <= 2 THEN s_acctbal ELSE 0.0 END AS s_acctbal
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def replace_table(t):
    path = workspace(t.spark, "replace")
    writers.replace_table(t.supplier.withColumn("s_acctbal", F.lit(0.0)), path, "s_nationkey")
    near = t.nation.filter(F.col("n_regionkey") <= 2).select(F.col("n_nationkey").alias("s_nationkey"))
    writers.replace_table(t.supplier.join(near, "s_nationkey", "left_semi"), path, "s_nationkey")
    return read_table(t.spark, path)


@check("replace_in_place", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders
WHERE o_orderdate >= DATE '1995-01-01'
""")
def replace_in_place(t):
    """A table is purged and then updated, each time from its own rows and at its own place."""
    path = workspace(t.spark, "in_place")
    writers.replace_table(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate"), path)
    writers.replace_table(read_table(t.spark, path).filter("o_orderdate >= DATE '1995-01-01'"), path)
    price = F.when(F.col("o_orderstatus") == "O", F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("o_totalprice")
    writers.replace_table(read_table(t.spark, path).select("o_orderkey", "o_custkey", price), path)
    return read_table(t.spark, path)


@check("staged_insert", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def staged_insert(t):
    path = workspace(t.spark, "staged")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    writers.append_table(rows.filter(F.col("o_orderstatus") == "F").drop("o_orderstatus"), path)
    overlap = rows.filter(F.col("o_orderstatus") != "P").drop("o_orderstatus")
    for staging in (overlap, overlap, rows.drop("o_orderstatus")):
        target = t.spark.read.schema(staging.schema).parquet(path)
        writers.append_table(writers.staged_insert(target, staging, ["o_orderkey"]), path)
    return t.spark.read.schema(rows.drop("o_orderstatus").schema).parquet(path)


@check("staged_insert_bounded", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def staged_insert_bounded(t):
    """Batches of growing keys that overlap by a third: the target is read only where a batch's keys lie."""
    path = workspace(t.spark, "staged_bounded")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    writers.append_table(rows.limit(0), path)
    third = t.orders.select(F.expr("1 + max(o_orderkey) div 3")).scalar()
    for i in range(3):
        staging = rows.filter(F.col("o_orderkey").between(third * max(0, i - 1), third * (i + 1)))
        target = t.spark.read.schema(rows.schema).parquet(path)
        writers.append_table(writers.staged_insert(target, staging, ["o_orderkey"], bounded=["o_orderkey"]), path)
    return t.spark.read.schema(rows.schema).parquet(path)


@check("csv_export", "SELECT * FROM supplier")
def csv_export(t):
    path = workspace(t.spark, "csv")
    writers.csv_export(t.supplier, path)
    return t.spark.read.schema(t.supplier.schema).option("header", True).csv(path)


BODY_SQL = """o_orderpriority || ' for ' || o_custkey || ' on ' || strftime(o_orderdate, '%Y-%m-%d')
    || CASE WHEN o_orderstatus = 'F' THEN ' and finished' ELSE '' END"""


@check("delimited_lines", f"""
WITH b AS (SELECT *, {BODY_SQL} AS body FROM orders)
SELECT o_orderkey || ' ;' || o_orderstatus || ' ;' ||
  CASE WHEN length(body) > 40 THEN left(body, 38) || '..' ELSE rpad(body, 40, ' ') END AS line FROM b
""")
def delimited_lines(t):
    body = F.concat(
        "o_orderpriority", F.lit(" for "), F.col("o_custkey").cast("string"), F.lit(" on "),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.when(F.col("o_orderstatus") == "F", " and finished").otherwise(""),
    )
    lines = writers.delimited_lines(
        t.orders.withColumn("body", body), ["o_orderkey", "o_orderstatus"], body="body"
    )
    path = workspace(t.spark, "lines")
    lines.write.text(path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


# The outcome that stands for each event type.
OUTCOME_OF = [
    ("click", "ok"), ("purchase", "max_failure"), ("error", "no_backup_rule"), ("signup", "snapshot"),
    ("view", "out_of_window"),
]


@check("command_log", """
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS database_name, 'collect' AS command, 'fleet' AS command_type,
  ts AS start_time, ts AS end_time,
  CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 222 WHEN 'error' THEN 223 WHEN 'signup' THEN 225
    WHEN 'view' THEN 231 END AS error_number,
  CASE WHEN event_type = 'click' THEN NULL ELSE props END AS error_message
FROM events
""")
def command_log(t):
    outcome = readers.inline_rows(t.spark, OUTCOME_OF, "event_type string, outcome string")
    rows = dict_lookup(t.events, "event_type", outcome).select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("database_name"),
        F.lit("collect").alias("command"), F.lit("fleet").alias("command_type"),
        F.col("ts").alias("start_time"), F.col("ts").alias("end_time"), "outcome",
        F.when(F.col("event_type") != "click", F.col("props")).alias("error_message"),
    )
    codes = readers.inline_rows(t.spark, OUTCOME_CODES, "outcome string, error_number int")
    return writers.command_log(rows, "outcome", codes)
