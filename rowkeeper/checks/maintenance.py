from __future__ import annotations

from pyspark.sql import functions as F

from rowkeeper.checks.registry import ORDERS_AS_OF, check
from rowkeeper.operators import maintenance
from rowkeeper.plans import stored
from rowkeeper.session import workspace
from rowkeeper.sources.versions import publish, read_table
from rowkeeper.sources.writers import append_table


@check("full_sync", """
WITH t AS (SELECT c_name AS name, CAST(c_acctbal AS DECIMAL(18,2)) AS balance, c_mktsegment AS segment FROM customer
    WHERE c_mktsegment <> 'FURNITURE'),
  s AS (SELECT c_name AS name, CAST(c_acctbal AS DECIMAL(18,2)) + 100 AS balance, nullif(c_mktsegment, 'BUILDING') AS segment
    FROM customer WHERE c_acctbal > 0
    UNION ALL SELECT s_name, CAST(s_acctbal AS DECIMAL(18,2)), 'SUPPLIER' FROM supplier)
SELECT coalesce(t.name, s.name) AS name,
  CAST(CASE WHEN s.name IS NOT NULL THEN s.balance ELSE t.balance END AS DECIMAL(18,2)) AS balance,
  CASE WHEN s.name IS NOT NULL THEN s.segment ELSE t.segment END AS segment,
  CASE WHEN s.name IS NULL THEN 'delete' WHEN t.name IS NULL THEN 'insert' ELSE 'update' END AS action
FROM t FULL OUTER JOIN s ON t.name = s.name
""")
def full_sync(t):
    customers = t.customer.select(
        F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"),
        F.col("c_mktsegment").alias("segment"), "c_acctbal",
    )
    target = customers.filter(F.col("segment") != "FURNITURE").drop("c_acctbal")
    changed = customers.filter(F.col("c_acctbal") > 0).select(
        "name", (F.col("balance") + 100).cast("decimal(18,2)").alias("balance"),
        F.nullif("segment", F.lit("BUILDING")).alias("segment"),
    )
    added = t.supplier.select(
        F.col("s_name").alias("name"), F.col("s_acctbal").cast("decimal(18,2)").alias("balance"),
        F.lit("SUPPLIER").alias("segment"),
    )
    return maintenance.full_sync(target, changed.union(added), ["name"], ["balance", "segment"])


LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]


@check("full_sync_composite", """
WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n_lines,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity, 'Active' AS status
    FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL),
  s AS (SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n_lines,
    nullif(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)), 10) AS quantity
    FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT coalesce(t.l_orderkey, s.l_orderkey) AS l_orderkey, coalesce(t.l_partkey, s.l_partkey) AS l_partkey,
  coalesce(t.l_suppkey, s.l_suppkey) AS l_suppkey,
  CASE WHEN s.n_lines IS NOT NULL THEN s.n_lines ELSE t.n_lines END AS n_lines,
  CASE WHEN s.n_lines IS NOT NULL THEN s.quantity ELSE t.quantity END AS quantity, t.status,
  CASE WHEN s.n_lines IS NULL THEN 'delete' WHEN t.n_lines IS NULL THEN 'insert' ELSE 'update' END AS action
FROM t FULL OUTER JOIN s
  ON t.l_orderkey = s.l_orderkey AND t.l_partkey = s.l_partkey AND t.l_suppkey = s.l_suppkey
""")
def full_sync_composite(t):
    def lines(keep, quantity):
        return t.lineitem.filter(keep).groupBy(*LINE_KEYS).agg(
            F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity")
        ).withColumn("quantity", quantity)

    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    target = lines(F.col("l_shipdate") < cut, F.col("quantity")).withColumn("status", F.lit("Active"))
    source = lines(F.col("l_returnflag") != "N", F.nullif("quantity", F.lit(10).cast("decimal(28,2)")))
    return maintenance.full_sync_composite(target, source, LINE_KEYS, ["n_lines", "quantity"])


@check("retention_purge", f"""
SELECT o_orderkey, placed FROM (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS placed
  FROM orders)
WHERE placed IS NULL OR placed > TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 2 YEAR
""")
def retention_purge(t):
    placed = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    rows = t.orders.select("o_orderkey", placed.alias("placed"))
    return maintenance.retention_purge(rows, "placed", 2, ORDERS_AS_OF)


@check("status_update", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Booked' WHEN o_orderpriority = '2-HIGH' THEN NULL
  ELSE o_orderstatus END AS status,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS is_selected
FROM orders
""")
def status_update(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("is_selected"))
    changes = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "Booked").alias("status"),
        F.lit(1).alias("is_selected"),
    )
    return maintenance.status_update(rows, changes, "o_orderkey", ["status", "is_selected"])


@check("change_table", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Booked' ELSE o_orderstatus END AS status
FROM orders WHERE o_orderdate > TIMESTAMP '1999-01-01' - INTERVAL 4 YEAR AND o_custkey % 3 <> 0
""")
def change_table(t):
    """A stored table is purged, updated and synchronised, each as one commit."""
    path = workspace(t.spark, "changed")
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("placed"))
    publish(rows, path)
    stored.change_table(t.spark, path, lambda df: maintenance.retention_purge(df, "placed", 4, ORDERS_AS_OF))
    urgent = t.orders.filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", F.lit("Booked").alias("status"))
    stored.change_table(t.spark, path, lambda df: maintenance.status_update(df, urgent, "o_orderkey", ["status"]))
    kept = t.orders.filter((F.col("o_custkey") % 3 != 0) & (F.col("o_orderdate") > F.lit("1995-01-01").cast("timestamp_ntz")))
    source = kept.join(read_table(t.spark, path).select("o_orderkey", "status"), "o_orderkey").select("o_orderkey", "status")
    stored.change_table(
        t.spark, path,
        lambda df: maintenance.synced_table(maintenance.full_sync(df.drop("placed"), source, ["o_orderkey"], ["status"])),
    )
    return read_table(t.spark, path)


@check("disable_rules", """
WITH f AS (SELECT DISTINCT p_brand, p_type, p_size FROM part WHERE p_retailprice > 2000 OR p_name LIKE 'red%')
SELECT p.p_partkey, p.p_brand, p.p_type, p.p_size, CASE WHEN f.p_brand IS NOT NULL THEN 'Disabled' ELSE 'Enabled' END AS status
FROM part p LEFT JOIN f ON p.p_brand = f.p_brand AND p.p_type = f.p_type AND p.p_size = f.p_size
""")
def disable_rules(t):
    rules = t.part.select("p_partkey", "p_brand", "p_type", "p_size", F.lit("Enabled").alias("status"))
    failed = t.part.filter((F.col("p_retailprice") > 2000) | F.col("p_name").like("red%"))
    return maintenance.disable_rules(rules, failed, ["p_brand", "p_type", "p_size"])


@check("split_by_target", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def split_by_target(t):
    path = workspace(t.spark, "targets")
    maintenance.split_by_target(t.supplier, "s_nationkey", path)
    return read_table(t.spark, path)


def loaded_before(t, day):
    return t.events.filter(F.col("ts") < F.lit(day).cast("timestamp_ntz"))


@check("incremental_append", """
WITH l AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16'),
  m AS (SELECT user_id, max(event_id) AS mark FROM l GROUP BY user_id)
SELECT event_id, ts, user_id, event_type, value, props FROM l
UNION ALL
SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, e.props FROM events e LEFT JOIN m ON e.user_id = m.user_id
WHERE e.ts >= TIMESTAMP '2024-01-10' AND e.event_id > coalesce(m.mark, 0)
""")
def incremental_append(t):
    loaded = loaded_before(t, "2024-01-16")
    none = t.events.select("user_id", F.col("event_id").alias("mark")).limit(0)
    path = workspace(t.spark, "marks")
    append_table(maintenance.advance_marks(none, loaded, "user_id", "event_id"), path)
    marks = t.spark.read.schema("user_id bigint, mark bigint").parquet(path)
    batch = t.events.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return maintenance.incremental_append(loaded, batch, marks, "user_id", "event_id")
