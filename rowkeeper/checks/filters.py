from __future__ import annotations

from pyspark.sql import functions as F

from rowkeeper.checks.registry import EVENTS_AS_OF, ORDERS_AS_OF, check
from rowkeeper.functions import scalars
from rowkeeper.operators import filters

TOKENS_SQL = r"""
SELECT lang, unnest(list_transform(
    list_filter(string_split_regex(text, '[ \t\n\f\r<>()\[\]",;:]+'), lambda w: contains(w, '@')),
    lambda w: rtrim(w, '.'))) AS address
FROM documents
"""


@check("recent_rows", f"""
SELECT event_id, ts, user_id FROM events WHERE ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 10 DAY
""")
def recent_rows(t):
    return filters.recent_rows(t.events, "ts", 10, EVENTS_AS_OF).select("event_id", "ts", "user_id")


@check("eligible_rows", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') r ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND l_orderkey IS NULL
""")
def eligible_rows(t):
    returned = t.lineitem.filter(F.col("l_returnflag") == "R").select("l_orderkey").distinct()
    joined = t.orders.join(returned, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    conditions = [
        F.col("o_orderstatus") == "O", F.col("o_orderpriority") == "1-URGENT", F.col("l_orderkey").isNull(),
    ]
    return filters.eligible_rows(joined, conditions).select("o_orderkey", "o_custkey", "o_totalprice")


@check("in_not_in", """
SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')
""")
def in_not_in(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    urgent = filters.in_not_in(rows, "o_orderpriority", include=["1-URGENT", "2-HIGH"])
    return filters.in_not_in(urgent, "o_orderstatus", exclude=["P"])


@check("name_patterns", """
SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' OR p_name ILIKE '%red%wid%'
""")
def name_patterns(t):
    return filters.name_patterns(t.part.select("p_partkey", "p_name"), "p_name", ["%RING%", "%red%wid%"])


@check("project_calc", f"""
SELECT l_orderkey AS order_id, 'lineitem' AS source, '{ORDERS_AS_OF}' AS collected_at,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS net_price
FROM lineitem
""")
def project_calc(t):
    net = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return filters.project_calc(t.lineitem, {
        "order_id": F.col("l_orderkey"), "source": F.lit("lineitem"), "collected_at": F.lit(ORDERS_AS_OF),
        "net_price": net.cast("decimal(18,4)"),
    })


@check("open_window", f"""
SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 90 DAY > TIMESTAMP '{ORDERS_AS_OF}' THEN 'open'
  ELSE 'out_of_window' END AS window_state FROM orders
""")
def open_window(t):
    windows = t.orders.select("o_orderkey", scalars.plus(F.col("o_orderdate"), days=90).alias("window_end"))
    return filters.open_window(windows, "window_end", ORDERS_AS_OF).drop("window_end")


@check("merged_since", """
SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1998-01-01'
""")
def merged_since(t):
    merged = t.orders.filter(F.col("o_orderstatus") == "F")
    return filters.merged_since(
        merged, "o_orderdate", "1998-01-01", ["o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"]
    )


@check("non_blank", """
SELECT doc_id, note FROM (
  SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN '' WHEN l.quality = 1 THEN d.source END AS note
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
WHERE note IS NOT NULL AND note <> ''
""")
def non_blank(t):
    noted = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("toxic") == 1, "").when(F.col("quality") == 1, F.col("source")).alias("note")
    )
    return filters.non_blank(noted, "note")


@check("clamp_default", """
SELECT c_custkey, greatest(coalesce(CASE WHEN c_mktsegment <> 'FURNITURE' THEN CAST(c_acctbal AS DECIMAL(12,2)) - 5000
  END, 100), 0)::DECIMAL(18,2) AS over FROM customer
""")
def clamp_default(t):
    over = F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_acctbal").cast("decimal(12,2)") - 5000)
    rows = t.customer.select("c_custkey", over.cast("decimal(18,2)").alias("over"))
    return filters.clamp_default(rows, "over", 100).withColumn("over", F.col("over").cast("decimal(18,2)"))


@check("validate_plan", """
SELECT o_orderkey, o_orderpriority, o_totalprice,
  CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'invalid_action'
    WHEN o_totalprice > 35000 THEN 'too_big' END AS reject_reason
FROM orders
""")
def validate_plan(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return filters.validate_plan(rows, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "o_totalprice")


@check("email_quality", rf"""
WITH found AS ({TOKENS_SQL})
SELECT lang, regexp_matches(address, '^([\p{{L}}\p{{N}}]+|[^@.]*[-_][^@.]*)@[\p{{L}}\p{{N}}]+\.[^@.]{{0,3}}$') AS valid,
  count(*) AS n_addresses
FROM found GROUP BY ALL
""")
def email_quality(t):
    return filters.email_quality(t.documents, "text", ["lang"])
