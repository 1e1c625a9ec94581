from __future__ import annotations

from pyspark.sql import functions as F

from rowkeeper.checks.registry import check
from rowkeeper.operators import ordering
from rowkeeper.plans import booking
from rowkeeper.schemas import METADATA
from rowkeeper.sources.readers import inline_rows
from rowkeeper.sources.versions import read_table
from rowkeeper.session import workspace
from rowkeeper.sources.writers import append_table

QUEUE_COLUMNS = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice"]
QUEUE_ORDER = ["o_orderdate", "o_totalprice", "o_orderkey"]


def queued(t):
    return t.orders.filter(F.col("o_orderstatus") == "O").select(*QUEUE_COLUMNS)


@check("next_in_queue", """
SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END,
    o_orderdate, o_totalprice, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O') WHERE rn = 1
""")
def next_in_queue(t):
    return ordering.next_in_queue(queued(t), QUEUE_ORDER, F.col("o_orderpriority") == "1-URGENT", ["o_custkey"])


@check("next_in_queue_overall", """
SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_orderdate, o_totalprice, o_orderkey LIMIT 1
""")
def next_in_queue_overall(t):
    return ordering.next_in_queue(queued(t), QUEUE_ORDER)


# Three jobs are booked one after the other: logs (finished orders here) go first, then the earliest window and the smallest delta.
BOOKED_SQL = """
WITH q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'L' ELSE 'D' END AS backup_type,
    date_trunc('month', o_orderdate) AS current_window_start, CAST(o_custkey % 50 AS INTEGER) AS backup_delta, o_orderdate AS queue_time,
    CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END AS unqueue_time,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS is_selected FROM orders),
  r AS (SELECT id, row_number() OVER (ORDER BY CASE backup_type WHEN 'L' THEN 0 ELSE 1 END, current_window_start, backup_delta,
    queue_time, id) AS place FROM q WHERE is_selected = 0 AND unqueue_time IS NULL)
SELECT q.id, q.backup_type, CASE WHEN place <= 3 THEN 1 ELSE is_selected END AS is_selected, coalesce(place <= 3, false) AS booked_now
FROM q LEFT JOIN r ON q.id = r.id
"""


@check("book_next", BOOKED_SQL)
def book_next(t):
    queue = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "L").otherwise("D").alias("backup_type"),
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("current_window_start"),
        (F.col("o_custkey") % 50).cast("int").alias("backup_delta"), F.col("o_orderdate").alias("queue_time"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")).alias("unqueue_time"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("is_selected"), F.lit("queued").alias("status"),
    )
    metadata = inline_rows(t.spark, [("all", "LP", "log priority", "1")], METADATA)
    path = workspace(t.spark, "queue")
    booking.store_queue(queue, path)
    booked = [booking.book_next(t.spark, path, metadata) for _ in range(3)]
    return read_table(t.spark, path).select("id", "backup_type", "is_selected", F.col("id").isin(booked).alias("booked_now"))


@check("oldest_eligible", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'
ORDER BY o_orderkey LIMIT 1
""")
def oldest_eligible(t):
    conditions = [F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "5-LOW"]
    return ordering.oldest_eligible(t.orders, conditions, "o_orderkey").select("o_orderkey", "o_custkey")


@check("sample_per_source", """
SELECT event_type, event_id, ts, position FROM (
  SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position
  FROM events) WHERE position <= 5
""")
def sample_per_source(t):
    rows = t.events.select("event_type", "event_id", "ts")
    return ordering.sample_per_source(rows, "event_type", ["ts", "event_id"], 5)


@check("kth_row", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
WHERE rn = 3
""")
def kth_row(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return ordering.kth_row(rows, ["-o_totalprice", "o_orderkey"], 3, ["o_custkey"])


@check("kth_row_far", """
SELECT l_returnflag, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipmode DESC, l_partkey, l_orderkey DESC, l_linenumber) AS rn FROM (
    SELECT l_returnflag, l_shipdate::VARCHAR AS l_shipmode, l_partkey, l_orderkey, l_linenumber FROM lineitem))
WHERE rn = 1500
""")
def kth_row_far(t):
    """A place beyond the group limit in an order of both directions, text among them."""
    rows = t.lineitem.select("l_returnflag", F.col("l_shipdate").cast("string").alias("l_shipmode"), "l_partkey", "l_orderkey", "l_linenumber")
    found = ordering.kth_row(rows, ["-l_shipmode", "l_partkey", "-l_orderkey", "l_linenumber"], 1500, ["l_returnflag"])
    return found.select("l_returnflag", "l_orderkey", "l_linenumber")


@check("multi_key_sort", """
SELECT n_name, n_customers, row_number() OVER (ORDER BY n_customers DESC, n_name) AS rank
FROM (SELECT n_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
""")
def multi_key_sort(t):
    counted = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    named = counted.join(t.nation, "n_nationkey").select("n_name", "n_customers")
    return ordering.multi_key_sort(named, ["-n_customers", "n_name"])


# The second mention of an item says nothing.
REFERENCE = ["3-MEDIUM", "1-URGENT", "5-LOW", "1-URGENT"]


@check("custom_order", """
SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 0
  WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 3 END, o_orderkey) AS rank FROM orders
""")
def custom_order(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return ordering.custom_order(rows, "o_orderpriority", REFERENCE, ["o_orderkey"])


@check("numeric_text_sort", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, row_number() OVER (ORDER BY p_size, p_partkey) AS rank FROM part
""")
def numeric_text_sort(t):
    rows = t.part.select("p_partkey", F.col("p_size").cast("string").alias("size_text"))
    return ordering.numeric_text_sort(rows, "size_text", ["p_partkey"])


@check("ordered_scan", "SELECT event_id, ts, user_id, event_type, value FROM events")
def ordered_scan(t):
    rows = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    path = workspace(t.spark, "scan")
    append_table(ordering.ordered_scan(rows, "event_id"), path)
    return t.spark.read.schema(rows.schema).parquet(path)
